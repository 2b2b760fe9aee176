"""Replacement by many rules at once, without chaining.

All rules match the original cell. One rule is a plain ``regexp_replace``. For several, each rule's
matches get their positions from the pieces between them; all matches are sorted by start (then rule),
an overlap is an error, and the cell is put together from gaps and replacements. Rules that can match
the empty string need a scan that the JVM's functions do not do, and go through an Arrow UDF.

Rules that are all literal, case and all, take one pass with all texts as alternatives. No literal is part of another, so if that finds as many matches as
the rules do one by one, none overlap, and each match is replaced by what its text stands for; otherwise the error is looked for as above.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions import rx
from ..plans.model import ColumnRef, ConfigError, RuleCollision, resolve
from ..plans.operation import Operation


@dataclass(frozen=True)
class ReplaceRule:
    name: str | None = None
    from_: str | None = None
    to: str | None = None
    pattern: str | None = None
    replacement: str | None = None
    regex: bool = False


@dataclass(frozen=True)
class Compiled:
    id: str
    pattern: rx.Pattern
    to: str
    literal: str | None


def compile_rules(rules: list[ReplaceRule], ignore_case: bool = False) -> list[Compiled]:
    out = []
    for k, r in enumerate(rules):
        id = f"rule[{k}]" + (f' "{r.name}"' if r.name is not None else "")
        mine, other = (("pattern", "replacement"), ("from_", "to")) if r.regex else (("from_", "to"), ("pattern", "replacement"))
        if any(getattr(r, x) is not None for x in other):
            raise ConfigError(f"{id}: {' / '.join(other)} do not go with regex = {str(r.regex).lower()}")
        for x in mine:
            if getattr(r, x) is None:
                raise ConfigError(f"{id} has no {x.rstrip('_')}")
        p = rx.translate(r.pattern, id, ignore_case) if r.regex else rx.literal(r.from_, ignore_case)
        out.append(Compiled(id, p, r.replacement if r.regex else r.to, None if r.regex else r.from_))
    collide(out, ignore_case)
    return out


def collide(rules: list[Compiled], ignore_case: bool) -> None:
    """No literal may be, or be part of, another one's."""
    literals = [(r.id, r.literal.lower() if ignore_case else r.literal) for r in rules if r.literal is not None]
    for k, (id, text) in enumerate(literals):
        for other, more in literals[k + 1 :]:
            if text == more:
                raise RuleCollision(f"rules collide (the same text): {id}, {other}")
            if text in more or more in text:
                raise RuleCollision(f"rules collide (one is part of the other): {id}, {other}")


def _spans(c: Column, k: int, p: rx.Pattern) -> Column:
    """(start, rule, length) of the matches of one rule, from what it matches and what stands between."""
    found, between = F.regexp_extract_all(c, F.lit(p.java), F.lit(0)), F.split(c, p.java, -1)
    pieces = F.arrays_zip(F.transform(found, F.char_length).alias("m"), F.transform(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), F.char_length).alias("g"))
    none = F.array().cast("array<struct<s:int,r:int,l:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    walked = F.aggregate(
        pieces, start, lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), F.lit(k).alias("r"), x["m"].alias("l")))).alias("out")), lambda acc: acc["out"]
    )
    return F.when(c.rlike(p.java), walked).otherwise(none)


def _sorted_spans(c: Column, rules: list[Compiled]) -> Column:
    return F.array_sort(F.concat(*[_spans(c, k, r.pattern) for k, r in enumerate(rules)]))


def _overlap(spans: Column) -> Column:
    """The rules of the first two matches that overlap, or null."""
    n = F.size(spans)
    pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1))
    at = lambda i: spans[i - 1]
    bad = F.filter(pairs, lambda i: at(i)["s"] + at(i)["l"] > spans[i]["s"])
    return F.when(F.size(bad) > 0, F.struct(spans[bad[0] - 1]["r"].alias("a"), spans[bad[0]]["r"].alias("b")))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _native(rules: list[Compiled]):
    any_ = lambda c: functools.reduce(operator.or_, [c.rlike(r.pattern.java) for r in rules])
    to = F.array(*[F.lit(r.to) for r in rules])
    ids = F.array(*[F.lit(r.id) for r in rules])

    def put(c: Column) -> Column:
        built = lambda spans: F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, m: F.struct((m["s"] + m["l"]).alias("at"), F.concat(acc["out"], F.substring(c, acc["at"] + 1, m["s"] - acc["at"]), to[m["r"]]).alias("out")),
            lambda acc: F.concat(acc["out"], F.substring(c, acc["at"] + 1, F.char_length(c))),
        )
        return F.when(any_(c), _let(_sorted_spans(c, rules), built)).otherwise(c)

    def error(c: Column) -> Column:
        bad = _let(_let(_sorted_spans(c, rules), _overlap), lambda x: F.when(x.isNotNull(), F.concat(F.lit("matches overlap: "), ids[x["a"]], F.lit(", "), ids[x["b"]])))
        return F.when(any_(c), bad)

    return put, error, lambda c: [F.regexp_count(c, F.lit(r.pattern.java)) for r in rules]


def _literals(rules: list[Compiled]):
    java = "|".join(r.pattern.java for r in rules)
    to = F.create_map(*[x for r in rules for x in (F.lit(r.literal), F.lit(r.to))])
    _, slow_error, hits = _native(rules)

    def alone(c: Column) -> Column:
        return F.regexp_count(c, F.lit(java)) == functools.reduce(operator.add, hits(c))

    def put(c: Column) -> Column:
        new = F.transform(F.regexp_extract_all(c, F.lit(java), F.lit(0)), lambda m: to[m])
        return F.when(c.rlike(java), F.array_join(F.zip_with(F.split(c, java, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")).otherwise(c)

    return put, lambda c: F.when(c.rlike(java) & ~alone(c), slow_error(c)), hits


def _in_python(rules: list[Compiled], ignore_case: bool):
    """One cell: its text, the hits of each rule, and an error or None."""
    held: list = []

    def run(text: str | None):
        if not held:
            held.extend(rx.python_pattern(r.pattern.source, ignore_case) for r in rules)
        text, found = text or "", []
        for k, p in enumerate(held):
            end = -1
            for m in p.finditer(text):
                if m.start() == m.end() == end:
                    continue  # an empty match right behind a match is none
                end = m.end()
                found.append((m.start(), k, end))
        hits = [sum(f[1] == k for f in found) for k in range(len(rules))]
        found.sort(key=lambda f: f[0])
        error = next((f"matches overlap: {rules[x[1]].id}, {rules[y[1]].id}" for x, y in zip(found, found[1:]) if x[2] > y[0]), None)
        out, at = [], 0
        for start, k, end in found:
            out += [text[at:start], rules[k].to]
            at = end
        return "".join([*out, text[at:]]), hits, error

    return run


def _by_row(of):
    """The same for patterns that may match the empty string."""

    @F.pandas_udf("struct<text: string, hits: array<int>, error: string>")
    def run(s):
        import pandas as pd

        return pd.DataFrame([of(x) for x in s], columns=["text", "hits", "error"])

    return run


def replace(columns: list[ColumnRef] | None, rules: list[Compiled], header: list[str] | None, ignore_case: bool = False) -> Operation:
    """``columns`` None: all. A hit is a match."""
    targets = None if columns is None else [resolve(c, header) for c in columns]
    error = python = None
    if not rules:
        put, hits = (lambda c: c), (lambda c: [F.lit(0)])
    elif any(r.pattern.may_be_empty for r in rules):
        python = _in_python(rules, ignore_case)
        run = _by_row(python)
        put, hits = (lambda c: run(c)["text"]), (lambda c: [run(c)["hits"][k] for k in range(len(rules))])
        error = lambda c: run(c)["error"]
    elif len(rules) == 1:
        r = rules[0]
        put = lambda c: F.regexp_replace(c, r.pattern.java, rx.as_replacement(r.to))
        hits = lambda c: [F.regexp_count(c, F.lit(r.pattern.java))]
    elif all(r.literal is not None for r in rules) and not ignore_case:
        put, error, hits = _literals(rules)
    else:
        put, error, hits = _native(rules)
    return Operation(targets=targets, overwrite=put, cell_hits=hits, cell_error=error, in_python=python, rule_ids=[r.id for r in rules], counts_matches=True)
