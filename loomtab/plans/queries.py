"""Each operation over the given tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import basic, info, replace as R, similarity as S
from .operation import apply_named, statistics

COLORS = S.Dictionary((("red ring", ("red rings", "rod ring")), ("blue bolt", ("blue bolts",)), ("green gear", ()), ("small widget", ("tiny widget", "widget"))))
_CANDIDATES = COLORS.candidates(["casefold", "whitespace"])
_DICT_SQL = "(values " + ", ".join(f"('{c}', {e}, {k}, '{COLORS.entries[e][0]}')" for k, (c, e) in enumerate(_CANDIDATES)) + ") as d(cand, entry, ord, canonical)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op(name: str, columns: list[str], make, then=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name).select(*columns)
        out = apply_named(df, make(df.columns))
        return then(out) if then else out

    return run


def _stats(name: str, columns: list[str], make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name).select(*columns)
        return statistics(df, make(df.columns)).select("rows_processed", "rows_changed", "changes_total")

    return run


def _md5(column: str):
    return lambda df: df.withColumn(column, F.md5(F.col(column).cast("binary")))


def _similarity(algorithm: str, threshold: float = 0.5):
    return lambda header: S.similarity([S.SimilarityRule("p_name", COLORS, "best", "score", threshold, algorithm, ("casefold", "whitespace"))], header)


def _similarity_sql(score: str) -> str:
    return f"""
with x as (select p_partkey, p_name, regexp_replace(lower(p_name), '\\s', '', 'g') as t from part),
s as (select p_partkey, p_name, canonical, ord, {score} as sc from x, {_DICT_SQL}),
b as (select p_partkey, any_value(p_name) as p_name, max(struct_pack(s := sc, o := -ord, c := canonical)) as m from s group by p_partkey)
select p_partkey, p_name, case when m.s >= 0.5 then m.c else '<no match>' end as best, printf('%.4f', m.s) as score from b
"""


_LEV = "case when greatest(length(t), length(cand)) = 0 then 1.0::double else 1.0::double - levenshtein(t, cand)::double / greatest(length(t), length(cand)) end"
_BIGRAMS = "list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i::bigint, 2))"
_COMMON = "list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda h: h = g)), len(list_filter({b}, lambda h: h = g)))))".format(a=_BIGRAMS.format("t"), b=_BIGRAMS.format("cand"))
_DICE = f"case when t = cand then 1.0::double when length(t) < 2 or length(cand) < 2 then 0.0::double else 2.0::double * coalesce({_COMMON}, 0)::double / (length(t) - 1 + length(cand) - 1) end"

_MULTI = lambda header: R.replace(["text"], R.compile_rules([R.ReplaceRule(from_="e", to="3"), R.ReplaceRule(from_="a", to="4"), R.ReplaceRule(pattern="[o]", replacement="$0", regex=True)]), header)
_LITERAL = lambda header: R.replace(["text"], R.compile_rules([R.ReplaceRule(from_="the", to="$1\\x")]), header)
_REGEX = lambda header: R.replace(["text"], R.compile_rules([R.ReplaceRule(pattern="[0-9]+", replacement="#", regex=True)]), header)
_ANY_CASE = lambda header: R.replace(None, R.compile_rules([R.ReplaceRule(from_="Building", to="B")], True), header, True)


def _normalized(steps):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"), steps).cast("binary")).alias("h"))

    return run


def _metric(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(table(spark, sf_dir, "part").select("p_partkey", "p_name"))

    return run


def _jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return apply_named(df, _similarity("jaro-winkler")(df.columns))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HALF = "".join(map(chr, range(0xFF71, 0xFF71 + 26)))
_FULL = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
_HIRA, _KATA = ("".join(chr(first + 2 * k) for k in range(26)) for first in (0x3042, 0x30A2))


def _written_as(to: str, steps, space: str = " "):
    """Names with their letters in another script, normalized."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = F.replace(F.translate(F.lower("p_name"), _LETTERS, to), F.lit(" "), F.lit(space))
        return table(spark, sf_dir, "part").select("p_partkey", T.normalize(given, steps).alias("name"))

    return run


def _rules(name: str, columns: list[str], make):
    """The statistics by rule."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name).select(*columns)
        return statistics(df, make(df.columns)).select(F.explode("per_rule").alias("r")).select("r.id", "r.rows_affected", F.coalesce("r.matches", F.lit(0).cast("long")).alias("matches"))

    return run


def _profile(name: str, build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", build(F.col("text")).alias(name))

    return run


_LINES = "list_slice(case when ends_with(text, chr(10)) then list_slice(string_split(text, chr(10)), 1, -2) else string_split(text, chr(10)) end, 1, 10)"


def _delimiter_sql() -> str:
    one = """select doc_id, {k} as k, {d} as d, w, count(*) as n, min(pos) as pos from (
  select doc_id, unnest(list_transform(l, lambda x: length(x) - length(replace(x, {d}, '')) + 1)) as w, generate_subscripts(l, 1) as pos from (select doc_id, {lines} as l from documents))
group by doc_id, w"""
    all_ = " union all ".join(one.format(k=k, d=d, lines=_LINES) for k, d in enumerate(("','", "chr(9)", "'|'", "';'")))
    return f"""
with c as ({all_}),
m as (select doc_id, k, d, arg_max(w, struct_pack(n := n, p := -pos)) as w, max(n) as n from c group by doc_id, k, d),
b as (select doc_id, arg_max(d, struct_pack(n := n, w := w, k := -k)) as d from m where w > 1 group by doc_id)
select documents.doc_id, coalesce(b.d, ',') as delimiter from documents left join b using (doc_id)
"""


def _hidden(char: str = "x"):
    return lambda header: basic.mask(["text"], header, char)


#: name: (Spark query, SQL or None: DuckDB's Damerau distance lets what was swapped be edited again, and its Jaro similarity rounds half swaps down)
QUERIES = {
    "mask_customer_name": (_op("customer", ["c_custkey", "c_name"], lambda h: basic.mask(["c_name"], h)), "select c_custkey, repeat('*', length(c_name)::bigint) as c_name from customer"),
    "mask_by_index": (_op("supplier", ["s_suppkey", "s_name"], lambda h: basic.mask([1], h, "#!")), "select s_suppkey, repeat('#', length(s_name)::bigint) as s_name from supplier"),
    "mask_multibyte": (_op("documents", ["doc_id", "text"], _hidden(), _md5("text")), "select doc_id, md5(repeat('x', length(coalesce(text, ''))::bigint)) as text from documents"),
    "flag_url": (_op("pages", ["page_id", "url"], lambda h: basic.flag([basic.FlagRule(["url"], "[0-9]{2}", "hit", "Y", "N")], h)), "select page_id, url, case when regexp_matches(url, '[0-9]{2}') then 'Y' else 'N' end as hit from pages"),
    "flag_multi_column": (
        _op("pages", ["page_id", "url", "html"], lambda h: basic.flag([basic.FlagRule(["url", "html"], "(?i)license|copyright", "a"), basic.FlagRule(["html"], "<script", "b")], h), lambda df: df.drop("html", "url")),
        "select page_id, case when regexp_matches(url, '(?i)license|copyright') or regexp_matches(html, '(?i)license|copyright') then 'true' else 'false' end as a, case when regexp_matches(html, '<script') then 'true' else 'false' end as b from pages",
    ),
    "extract_numbers": (_op("events", ["event_id", "props"], lambda h: basic.extract([basic.ExtractRule("props", "[0-9]+", "numbers", ";")], h)), "select event_id, props, array_to_string(regexp_extract_all(coalesce(props, ''), '[0-9]+'), ';') as numbers from events"),
    "extract_group": (
        _op("documents", ["doc_id", "text"], lambda h: basic.extract([basic.ExtractRule("text", r"([a-z]+)\.", "ends", "|")], h), lambda df: _md5("ends")(df.drop("text"))),
        "select doc_id, md5(array_to_string(regexp_extract_all(coalesce(text, ''), '([a-z]+)\\.', 1), '|')) as ends from documents",
    ),
    "replace_literal": (_op("documents", ["doc_id", "text"], _LITERAL, _md5("text")), "select doc_id, md5(replace(coalesce(text, ''), 'the', '$1\\x')) as text from documents"),
    "replace_regex": (_op("documents", ["doc_id", "text"], _REGEX, _md5("text")), "select doc_id, md5(regexp_replace(coalesce(text, ''), '[0-9]+', '#', 'g')) as text from documents"),
    "replace_multi": (_op("conversations", ["conv_id", "turn", "text"], _MULTI, _md5("text")), "select conv_id, turn, md5(replace(translate(coalesce(text, ''), 'eao', '34' || chr(2)), chr(2), '$0')) as text from conversations"),
    "replace_all_columns": (_op("customer", ["c_name", "c_mktsegment"], _ANY_CASE), "select regexp_replace(c_name, 'Building', 'B', 'gi') as c_name, regexp_replace(c_mktsegment, 'Building', 'B', 'gi') as c_mktsegment from customer"),
    "split_part_name": (_op("part", ["p_partkey", "p_name"], lambda h: basic.split("p_name", " ", ["w1", "w2"], h)), "select p_partkey, p_name, split_part(p_name, ' ', 1) as w1, case when instr(p_name, ' ') > 0 then substr(p_name, instr(p_name, ' ') + 1) else '' end as w2 from part"),
    "split_priority": (_op("orders", ["o_orderkey", "o_orderpriority"], lambda h: basic.split("o_orderpriority", "-", ["rank", "word"], h)), "select o_orderkey, o_orderpriority, split_part(o_orderpriority, '-', 1) as rank, case when instr(o_orderpriority, '-') > 0 then substr(o_orderpriority, instr(o_orderpriority, '-') + 1) else '' end as word from orders"),
    "similarity_levenshtein": (_op("part", ["p_partkey", "p_name"], _similarity("levenshtein")), _similarity_sql(_LEV)),
    "similarity_damerau": (_op("part", ["p_partkey", "p_name"], _similarity("damerau")), None),
    "similarity_dice": (_op("part", ["p_partkey", "p_name"], _similarity("dice")), _similarity_sql(_DICE)),
    "similarity_jaro_winkler": (_jaro_winkler, None),
    "levenshtein_distance": (_metric(lambda df: df.select("p_partkey", F.levenshtein("p_name", F.lit("small red widget")).alias("d"))), "select p_partkey, levenshtein(p_name, 'small red widget')::int as d from part"),
    "normalize_lower": (_normalized(["casefold"]), "select doc_id, md5(lower(text)) as h from documents"),
    "normalize_whitespace": (_normalized(["whitespace"]), "select doc_id, md5(regexp_replace(text, '[\\s\\x{0b}\\x{85}\\p{Z}]', '', 'g')) as h from documents"),
    "normalize_nfkc": (_normalized(["nfkc"]), None),
    "normalize_kana": (_normalized(["fullwidth", "prolonged", "kana"]), "select doc_id, md5(replace(replace(text, chr(8212), chr(12540)), chr(8213), chr(12540))) as h from documents"),
    "normalize_nfkc_names": (_written_as("".join(chr(ord(c) + 0xFEE0) for c in _LETTERS), ["nfkc"], "\u3000"), "select p_partkey, lower(p_name) as name from part"),
    "normalize_fullwidth_names": (_written_as(_HALF, ["fullwidth"], "\uff76\uff9e\uff8a\uff9f\uff9e"), f"select p_partkey, replace(translate(lower(p_name), '{_LETTERS}', '{_FULL}'), ' ', 'ガパ゛') as name from part"),
    "normalize_kana_names": (_written_as(_HIRA, ["kana"]), f"select p_partkey, translate(lower(p_name), '{_LETTERS}', '{_KATA}') as name from part"),
    "normalize_prolonged_names": (_written_as(_LETTERS, ["prolonged"], "\uff70\u2014\u2015\uff0d"), "select p_partkey, replace(lower(p_name), ' ', 'ーーーー') as name from part"),
    "flag_classes": (
        _op("part", ["p_partkey", "p_name", "p_brand"], lambda h: basic.flag([basic.FlagRule(["p_name"], r"[\p{Ll}--aeiou]{5}", "a"), basic.FlagRule(["p_brand"], "[[:digit:]&&[^1-3]]$", "b"), basic.FlagRule(["p_name", "p_brand"], r"\p{Lu}|\x{6d}", "c")], h)),
        "select p_partkey, p_name, p_brand, case when regexp_matches(p_name, '[b-df-hj-np-tv-z]{5}') then 'true' else 'false' end as a, case when regexp_matches(p_brand, '[04-9]$') then 'true' else 'false' end as b, case when regexp_matches(p_name || p_brand, '[A-Zm]') then 'true' else 'false' end as c from part",
    ),
    "extract_classes": (_op("pages", ["page_id", "url"], lambda h: basic.extract([basic.ExtractRule("url", r"[\w--\d]+", "words", "|")], h)), "select page_id, url, array_to_string(regexp_extract_all(url, '[a-zA-Z_]+'), '|') as words from pages"),
    "replace_literals": (_op("documents", ["doc_id", "text"], lambda h: R.replace(["text"], R.compile_rules([R.ReplaceRule(from_=a, to=b) for a, b in (("x", "1"), ("q", "22"), ("z", ""), ("0", "$"))]), h), _md5("text")), "select doc_id, md5(replace(replace(replace(replace(coalesce(text, ''), 'x', '1'), 'q', '22'), 'z', ''), '0', '$')) as text from documents"),
    "rule_stats_flag": (_rules("lineitem", ["l_returnflag", "l_linestatus"], lambda h: basic.flag([basic.FlagRule(["l_returnflag"], "A|R", "a"), basic.FlagRule([0, 1], "F", "b")], h)), "select 'a' as id, count_if(l_returnflag in ('A', 'R'))::bigint as rows_affected, 0::bigint as matches from lineitem union all select 'b', count_if(l_linestatus = 'F' or l_returnflag = 'F')::bigint, 0 from lineitem"),
    "rule_stats_replace": (
        _rules("documents", ["text"], lambda h: R.replace(["text"], R.compile_rules([R.ReplaceRule("digits", pattern="[0-9]+", replacement="#", regex=True), R.ReplaceRule(from_="the", to="")]), h)),
        "select 'rule[0] \"digits\"' as id, count_if(regexp_matches(text, '[0-9]'))::bigint as rows_affected, sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')))::bigint as matches from documents union all select 'rule[1]', count_if(contains(text, 'the'))::bigint, sum(len(regexp_extract_all(coalesce(text, ''), 'the')))::bigint from documents",
    ),
    "line_ending_profile": (_profile("ending", info.line_ending_of), "select doc_id, case when instr(text, chr(13) || chr(10)) > 0 and regexp_matches(text, '(^|[^\\r])\\n') then 'mixed' when instr(text, chr(13) || chr(10)) > 0 then 'crlf' when instr(text, chr(10)) > 0 then 'lf' else 'none' end as ending from documents"),
    "delimiter_profile": (_profile("delimiter", info.delimiter_of), _delimiter_sql()),
    "stats_flag": (_stats("lineitem", ["l_returnflag", "l_linestatus"], lambda h: basic.flag([basic.FlagRule(["l_returnflag"], "A|R", "a"), basic.FlagRule([0, 1], "F", "b")], h)), "select count(*) as rows_processed, count_if(l_returnflag in ('A', 'R') or l_linestatus = 'F')::bigint as rows_changed, (count_if(l_returnflag in ('A', 'R')) + count_if(l_linestatus = 'F' or l_returnflag = 'F'))::bigint as changes_total from lineitem"),
    "stats_mask": (_stats("customer", ["c_name", "c_mktsegment"], lambda h: basic.mask(["c_name", "c_mktsegment"], h)), "select count(*) as rows_processed, count_if(c_name <> '' or c_mktsegment <> '')::bigint as rows_changed, (count_if(c_name <> '') + count_if(c_mktsegment <> ''))::bigint as changes_total from customer"),
    "stats_replace": (_stats("documents", ["text"], _REGEX), "select count(*) as rows_processed, count_if(regexp_matches(text, '[0-9]'))::bigint as rows_changed, sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')))::bigint as changes_total from documents"),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
