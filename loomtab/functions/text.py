"""Normalization steps and similarity of two strings, as columns.

What Spark has stays in the JVM; NFKC, restricted Damerau, Jaro-Winkler and the fixed rounding of a score are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

from ..plans.model import ConfigError

#: Order in which steps apply, whatever order they are asked for in.
STEPS = ("nfkc", "fullwidth", "prolonged", "kana", "casefold", "whitespace")
DEFAULT_STEPS = ("nfkc", "casefold", "whitespace")
ALGORITHMS = ("levenshtein", "damerau", "jaro-winkler", "dice")

#: Half-width forms U+FF61 to U+FF9D have their full-width ones by compatibility; the two marks stand alone.
_HALF = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFF9E)} | {"\uff9e": "\u309b", "\uff9f": "\u309c"}
#: Half-width letters that take a voiced or a half-voiced mark.
_VOICED = ["\uff73", *map(chr, range(0xFF76, 0xFF85)), *map(chr, range(0xFF8A, 0xFF8F))]
_HALF_VOICED = [*map(chr, range(0xFF8A, 0xFF8F))]
_MARKED = {c + m: unicodedata.normalize("NFC", _HALF[c] + mark) for of, m, mark in ((_VOICED, "\uff9e", "\u3099"), (_HALF_VOICED, "\uff9f", "\u309a")) for c in of}
#: Long marks that become U+30FC.
_LONG = "\uff70\u2014\u2015\uff0d"
#: Unicode's White_Space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


def steps(names) -> list[str]:
    """The named steps without repeats, in the order in which they apply."""
    names = list(names)
    for n in names:
        if n not in STEPS:
            raise ConfigError(f"unknown normalization {n!r}; there are: {', '.join(STEPS)}")
    return [s for s in STEPS if s in names]


@F.pandas_udf(StringType())
def nfkc(s):
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def _fullwidth(c: Column) -> Column:
    for pair, one in _MARKED.items():
        c = F.replace(c, F.lit(pair), F.lit(one))
    return F.translate(c, "".join(_HALF), "".join(_HALF.values()))


_STEP = {
    "nfkc": nfkc,
    "fullwidth": lambda c: F.when(c.rlike("[\uff61-\uff9f]"), _fullwidth(c)).otherwise(c),
    "prolonged": lambda c: F.translate(c, _LONG, "\u30fc" * len(_LONG)),
    "kana": lambda c: F.translate(c, _HIRAGANA, _KATAKANA),
    "casefold": F.lower,
    "whitespace": lambda c: F.translate(c, _SPACES, ""),
}


def normalize(c: Column, names=DEFAULT_STEPS) -> Column:
    for s in steps(names):
        c = _STEP[s](c)
    return c


def normalize_text(text: str, names=DEFAULT_STEPS) -> str:
    """The same for one string on the driver (dictionary entries)."""
    for s in steps(names):
        if s == "nfkc":
            text = unicodedata.normalize("NFKC", text)
        elif s == "fullwidth":
            for pair, one in _MARKED.items():
                text = text.replace(pair, one)
            text = text.translate(str.maketrans(_HALF))
        elif s == "prolonged":
            text = text.translate(str.maketrans(_LONG, "\u30fc" * len(_LONG)))
        elif s == "kana":
            text = text.translate(str.maketrans(_HIRAGANA, _KATAKANA))
        elif s == "casefold":
            text = text.lower()
        else:
            text = text.translate(dict.fromkeys(map(ord, _SPACES)))
    return text


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / most)


def _pairs(c: Column) -> Column:
    return F.when(F.char_length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def numbered_pairs(c: Column) -> Column:
    """The pairs of neighbouring characters, each with the number of equal ones before it: their set is the multiset of pairs."""
    numbered = lambda x: F.transform(x, lambda p, i: F.concat(p, F.size(F.filter(F.slice(x, 1, i), lambda y: y == p)).cast("string")))
    of = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.transform(x, lambda p: F.concat(p, F.lit("0")))).otherwise(numbered(x))
    return F.get(F.transform(F.array(_pairs(c)), of), F.lit(0))


def numbered_pairs_of(text: str) -> list[str]:
    """The same of one string on the driver."""
    out: dict[str, int] = {}
    found = []
    for pair in map("".join, zip(text, text[1:])):
        found.append(f"{pair}{out.get(pair, 0)}")
        out[pair] = out.get(pair, 0) + 1
    return found


def dice_of_pairs(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Dice's coefficient of two texts with their numbered pairs."""
    score = F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(score)


def dice_similarity(a: Column, b: Column) -> Column:
    """Twice the common pairs of neighbouring characters (counted with repeats) over all pairs."""
    return dice_of_pairs(a, b, numbered_pairs(a), numbered_pairs(b))


def osa_distance(a: str, b: str) -> int:
    """Edits, with a swap of neighbours as one, and no further edit of what was swapped."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def damerau(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1.0 - osa_distance(a, b) / most if most else 1.0


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, unmatched in zip(b, free) if not unmatched]
    m, t = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    j, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1.0 - j)


def _by_row(score):
    @F.pandas_udf(DoubleType())
    def similarity(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return similarity


SIMILARITY = {"levenshtein": levenshtein_similarity, "damerau": _by_row(damerau), "jaro-winkler": _by_row(jaro_winkler), "dice": dice_similarity}


def similarity(name: str):
    if name not in ALGORITHMS:
        raise ConfigError(f"unknown algorithm {name!r}; there are: {', '.join(ALGORITHMS)}")
    return SIMILARITY[name]


@F.pandas_udf(StringType())
def four_decimals(s):
    return s.map(lambda x: None if x is None or x != x else f"{x:.4f}")


def human_size(n: int) -> str:
    size, units = float(n), ["B", "KB", "MB", "GB", "TB"]
    k = 0
    while size >= 1024 and k < len(units) - 1:
        size, k = size / 1024, k + 1
    return f"{size:.1f} {units[k]}" if k else f"{n} B"


def group_digits(n: int) -> str:
    return f"{n:,}"
