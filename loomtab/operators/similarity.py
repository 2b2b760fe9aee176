"""Best match of a cell in a dictionary.

The dictionary, of a size that a driver reads from one file, travels as a literal. Levenshtein and Dice
are scored in the JVM, against the candidates in an array; the other two in an Arrow UDF that scores each distinct
value of a batch once. The first of the best candidates, in file order, wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions import text as T
from ..plans.model import ColumnRef, ConfigError, DictionaryError, check_new_columns, resolve
from ..plans.operation import Operation

DEFAULT_THRESHOLD = 0.7
NO_MATCH = "<no match>"


@dataclass(frozen=True)
class Dictionary:
    entries: tuple[tuple[str, tuple[str, ...]], ...]

    def __post_init__(self):
        if not self.entries:
            raise DictionaryError("the dictionary has no entries")
        names: set[str] = set()
        for n, _ in self.entries:
            if n in names:
                raise DictionaryError(f"canonical {n!r} stands twice")
            names.add(n)
        owner: dict[str, str] = {}
        for name, aliases in self.entries:
            for a in aliases:
                if owner.setdefault(a, name) != name:
                    raise DictionaryError(f"alias {a!r} belongs to {owner[a]!r} and {name!r}")

    def candidates(self, steps: list[str]) -> list[tuple[str, int]]:
        """Normalized texts with the number of their entry, canonicals before their aliases."""
        return [(T.normalize_text(t, steps), k) for k, (name, aliases) in enumerate(self.entries) for t in (name, *aliases)]


@dataclass(frozen=True)
class SimilarityRule:
    column: ColumnRef
    dictionary: Dictionary
    out_col: str = "matched_name"
    score_col: str = "score"
    threshold: float = DEFAULT_THRESHOLD
    algorithm: str = "levenshtein"
    normalize: tuple = T.DEFAULT_STEPS


def best_match(text: Column, dictionary: Dictionary, algorithm: str = "levenshtein", normalize=T.DEFAULT_STEPS) -> Column:
    """struct<canonical, score, tie> of the best candidate for a normalized string column. A tie is another entry of the same score."""
    metric = T.similarity(algorithm)
    some = dictionary.candidates(T.steps(normalize))
    names = [e[0] for e in dictionary.entries]
    if algorithm in ("damerau", "jaro-winkler"):
        return _by_row(some, names, T.damerau if algorithm == "damerau" else T.jaro_winkler)(text)
    dice = algorithm == "dice"
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    literal = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(-k).alias("o"), F.lit(e).alias("e"), *([strings(T.numbered_pairs_of(c)).alias("p")] if dice else [])) for k, (c, e) in enumerate(some)])
    let = lambda v, body: F.get(F.transform(F.array(v), body), F.lit(0))
    score = (lambda x, d: T.dice_of_pairs(x["t"], d["c"], x["p"], d["p"])) if dice else (lambda x, d: metric(x["t"], d["c"]))
    given = F.struct(text.alias("t"), *([T.numbered_pairs(text).alias("p")] if dice else []))
    scored = let(given, lambda x: F.transform(literal, lambda d: F.struct(score(x, d).alias("score"), d["o"].alias("o"), d["e"].alias("e"))))
    entry = F.array(*map(F.lit, names))

    def chosen(all_):
        def of(best):
            tie = F.exists(all_, lambda s: (s["score"] == best["score"]) & (s["e"] != best["e"]))
            return F.struct(entry[best["e"]].alias("canonical"), best["score"].alias("score"), tie.alias("tie"))

        return let(F.array_max(all_), of)

    return let(scored, chosen)


def _by_row(some, names, score):
    @F.pandas_udf("struct<canonical: string, score: double, tie: boolean>")
    def run(s):
        import pandas as pd

        def best(x):
            scores = [score(x or "", c) for c, _ in some]
            top = max(scores)
            entry = some[scores.index(top)][1]
            return names[entry], top, any(v == top and e != entry for v, (_, e) in zip(scores, some))

        known = {x: best(x) for x in s.unique()}
        return pd.DataFrame([known[x] for x in s], columns=["canonical", "score", "tie"])

    return run


def similarity(rules: list[SimilarityRule], header: list[str] | None) -> Operation:
    """For each rule the canonical (or ``<no match>``) and the score with 4 decimals."""
    check_new_columns([c for r in rules for c in (r.out_col, r.score_col)], header)
    at = [resolve(r.column, header) for r in rules]
    for r in rules:
        if not 0.0 <= r.threshold <= 1.0:
            raise ConfigError(f"threshold {r.threshold} is not from 0 to 1")
        T.similarity(r.algorithm), T.steps(r.normalize)

    name = lambda what, k: f"__{what}_{k}"
    prepare: list[dict] = [{}, {}, {}]
    for k, r in enumerate(rules):
        prepare[0][name("text", k)] = lambda cell, k=k, r=r: T.normalize(cell(at[k]), r.normalize)
        # not folded into the step behind it: a Python function takes no input with lambda functions in it
        prepare[1][name("best", k)] = lambda cell, k=k, r=r: F.when(F.monotonically_increasing_id() >= 0, best_match(F.col(name("text", k)), r.dictionary, r.algorithm, r.normalize))
        prepare[2][name("score", k)] = lambda cell, k=k: T.four_decimals(F.col(name("best", k))["score"])

    def append(cell) -> list[Column]:
        out = []
        for k, r in enumerate(rules):
            m = F.col(name("best", k))
            out += [F.when(m["score"] >= r.threshold, m["canonical"]).otherwise(F.lit(NO_MATCH)), F.col(name("score", k))]
        return out

    return Operation(
        targets=at,
        names=[c for r in rules for c in (r.out_col, r.score_col)],
        prepare=prepare,
        append=append,
        row_hits=lambda cell: [F.when(F.col(name("best", k))["score"] >= r.threshold, 1).otherwise(0) for k, r in enumerate(rules)],
        notes=F.filter(F.array(*[F.when(F.col(name("best", k))["tie"], F.lit(r.out_col)) for k, r in enumerate(rules)]), lambda x: x.isNotNull()),
        rule_ids=[r.out_col for r in rules],
    )
