import pytest

from loomtab.functions import rx, text as T
from loomtab.plans import model
from loomtab.sources import encoding as E


def test_distances():
    assert T.osa_distance("kitten", "sitting") == 3
    assert T.osa_distance("ab", "ba") == 1
    assert T.osa_distance("ca", "abc") == 3
    assert T.damerau("", "") == 1.0
    assert T.jaro("", "") == 1.0 and T.jaro("a", "") == 0.0
    assert T.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert T.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)


def test_similarity_columns(spark):
    from pyspark.sql import functions as F

    rows = [("東京", "東京都"), ("", ""), ("night", "nacht"), ("a", "a"), ("a", "b"), ("aaaa", "aa")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(T.levenshtein_similarity(F.col("a"), F.col("b")), T.dice_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out] == pytest.approx([2 / 3, 1.0, 0.6, 1.0, 0.0, 0.5])
    assert [r[1] for r in out] == pytest.approx([2 * 1 / 3, 1.0, 0.25, 1.0, 0.0, 0.5])


@pytest.mark.parametrize(
    "steps, given, wanted",
    [
        (["nfkc"], "ＡＢＣ①", "ABC1"),
        (["fullwidth"], "ｶﾞﾊﾟｱﾞ｡", "ガパア゛。"),
        (["fullwidth"], "ﾜﾞ", "ワ゛"),
        (["prolonged"], "ｰ—―－ー", "ーーーーー"),
        (["kana"], "とうきょうゖ", "トウキョウヶ"),
        (["casefold"], "ÀB", "àb"),
        (["whitespace"], "a　b \t\x85c", "abc"),
        ([], "Ａ b", "Ａ b"),
    ],
)
def test_normalization(spark, steps, given, wanted):
    from pyspark.sql import functions as F

    assert T.normalize_text(given, steps) == wanted
    assert spark.createDataFrame([(given,)], "x string").select(T.normalize(F.col("x"), steps)).first()[0] == wanted


def test_steps_have_an_order():
    assert T.steps(["whitespace", "nfkc", "nfkc"]) == ["nfkc", "whitespace"]
    with pytest.raises(model.ConfigError):
        T.steps(["upper"])


def test_patterns():
    assert rx.translate("a(b)?").first_group_sure is False
    assert rx.translate("a(b)").first_group_sure and rx.translate("a(b)").groups == 1
    assert rx.translate("a*").may_be_empty and not rx.translate("a+").may_be_empty
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "a++", "(", "[a"):
        with pytest.raises(model.InvalidRegex):
            rx.translate(bad)


@pytest.mark.parametrize("pattern, text, hit", [(r"\d", "１", True), ("a$", "a\n", False), (r"^\w+$", "é", True), ("(?i)É", "é", True), (r"[$]", "$", True), (r"\$", "$", True)])
def test_pattern_dialect(spark, pattern, text, hit):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "x string").select(F.col("x").rlike(rx.translate(pattern).java)).first()[0] is hit


def test_encodings():
    assert E.detect(b"\xef\xbb\xbfa") == ("utf-8", True)
    assert E.detect("東".encode()[:2]) == ("utf-8", False)
    assert E.detect("東京".encode("cp932")) == ("shift_jis", False)
    head = b"id,name\n" * (E.SAMPLE // 8)
    assert E.detect_file(head + "東京\n".encode("cp932")) == "shift_jis"
    assert E.detect_file(head * 3 + "東京\n".encode() * 30000) == "utf-8"
    assert [E.line_ending(x) for x in (b"", b"a\n", b"a\r\n", b"a\r\nb\n")] == ["none", "lf", "crlf", "mixed"]
    assert E.guess_delimiter("id,name,note;memo,extra\n1,2,3,4\n") == ","
    assert E.guess_delimiter("a\tb\n1\t2\n") == "\t" and E.guess_delimiter("a\n") == ","
    with pytest.raises(model.EncodingError):
        E.encoding_name("UTF-8")


def test_columns():
    assert model.parse_columns("a, 2,") == ["a", 2, ""]
    assert model.resolve("b", ["a", "b", "b"]) == 1
    for ref, header, error in (("x", ["a"], model.UnknownColumn), (1, ["a"], model.IndexOutOfRange), ("a", None, model.NameWithoutHeaders)):
        with pytest.raises(error):
            model.resolve(ref, header)
    with pytest.raises(model.OutputColumnConflict):
        model.check_new_columns(["n", "n"], ["a"])


def test_sizes():
    assert [T.human_size(n) for n in (45, 1024, 1536, 5 * 1024**3)] == ["45 B", "1.0 KB", "1.5 KB", "5.0 GB"]
    assert T.group_digits(1234567) == "1,234,567"
