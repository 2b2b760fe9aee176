"""Patterns: the JVM and Python find the same, and what the dialect says."""

import random

import pytest
from pyspark.sql import functions as F

from loomtab.functions import rx
from loomtab.plans.model import InvalidRegex

#: pattern, text, all matches
CASES = [
    (r"\p{Han}+", "山田 taro 川", ["山田", "川"]), (r"\p{Hiragana}", "aあイ", ["あ"]), (r"\p{Script=Katakana}+", "アイx", ["アイ"]), (r"\P{Han}", "山x", ["x"]), (r"\pL+", "é1b", ["é", "b"]),
    (r"[[:digit:]]+", "d5i６7", ["5", "7"]), (r"[[:^alpha:]]", "a-b", ["-"]), (r"[a-z--m]+", "klmno", ["kl", "no"]), (r"[a-f~~d-z]+", "abdezy", ["ab", "zy"]), (r"[\w&&[^_]]+", "a_b", ["a", "b"]),
    (r"[^a-c&&b-d]", "abcd", ["a", "d"]), (r"\x{6771}|\u{4eac}|\x41", "東京A", ["東", "京", "A"]), (r"[\p{Han}a-c&&[^山]]+", "山川ab", ["川ab"]), (r"(?i)straße|É", "STRAßE é", ["STRAßE", "é"]),
    (r"(?m)^a$", "a\nb\na", ["a", "a"]), (r"a$", "a\n", []), (r"^", "x\n", [""]), (r"(?s).+", "a\nb", ["a\nb"]), (r".+", "a\nb\r", ["a", "b\r"]), (r"(?U)a+", "aa", ["a", "a"]), (r"(?x) a  b # note", "ab", ["ab"]),
    (r"[]a]+", "]a[", ["]a"]), (r"[a-]+", "-a", ["-a"]), (r"\d{2,3}?", "1234", ["12", "34"]), (r"\s+", "a　\x85b", ["　\x85"]), (r"(?i:a)b", "Ab AB", ["Ab"]), (r"\.\*\-", ".*-", [".*-"]), (r"[a[b-d]]+", "abxd", ["ab", "d"]),
    (r"\p{Lowercase_Letter}+", "abC", ["ab"]), (r"\p{Any}", "\n", ["\n"]), (r"a|ab", "ab", ["a"]), (r"(?P<x>a)(?<y>b)", "ab", ["ab"]), (r"[\d\-x]+", "1-x", ["1-x"]), (r"\bあ", "あ い", ["あ"]),
]


def test_matches(spark):
    for k in range(0, len(CASES), 12):
        some = CASES[k : k + 12]
        df = spark.createDataFrame([tuple(c[1] for c in some)], [f"t{i}" for i in range(len(some))])
        got = df.select(*[F.regexp_extract_all(f"t{i}", F.lit(rx.translate(c[0]).java), F.lit(0)).alias(f"m{i}") for i, c in enumerate(some)]).first()
        for m, (pattern, text, want) in zip(got, some):
            assert [m[0] for m in rx.python_pattern(pattern).finditer(text)] == want, pattern
            assert m == want, (pattern, rx.translate(pattern).java)


def test_random_patterns_find_the_same_in_both(spark):
    random.seed(9)
    atoms = ["a", "b", "é", "東", r"\d", r"\w", r"\s", ".", "[a-c]", "[^b東]", "[[:alpha:]--a]", r"[\p{Han}0-5]", r"\p{L}", "(?i:A)", "(a|b東)", "(?:b|)"]
    patterns = ["".join(random.choice(atoms) + random.choice(["", "", "", "*", "+", "?", "{1,2}", "+?"]) for _ in range(random.randrange(1, 4))) for _ in range(60)]
    patterns = [p for p in patterns if not rx.translate(p).may_be_empty]
    texts = ["".join(random.choices("abcABé東京 05\n_", k=20)) for _ in range(30)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.regexp_extract_all("t", F.lit(rx.translate(p).java), F.lit(0)).alias(f"m{i}") for i, p in enumerate(patterns)], "t").collect()
    for p, i in zip(patterns, range(len(patterns))):
        compiled = rx.python_pattern(p)
        for r in got:
            assert r[i] == [m[0] for m in compiled.finditer(r["t"])], (p, r["t"])


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)", "(?<=a)", "(?>a)", r"(a)\1", r"\k<x>", "a++", "(", ")", "[a", "[z-a]", "*", "a{2,1}", r"\p{Nonesuch}", r"\q", "\\", r"\x{110000}", "(?-u)a", "a{x}"])
def test_refused(bad):
    with pytest.raises(InvalidRegex):
        rx.translate(bad)


def test_shape():
    assert rx.translate(r"(a|b)c").first_group_sure and not rx.translate("(a)|b").first_group_sure and rx.translate("(a)+").first_group_sure and not rx.translate("(a)*").first_group_sure
    assert rx.translate("a*|b").may_be_empty and rx.translate("(?:)").may_be_empty and not rx.translate("[^a]").may_be_empty and rx.translate(r"\b").may_be_empty
