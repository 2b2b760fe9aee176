"""Exact duplicates by a heavy-hitter split, in DataFrame operations only.

Texts are equal when they are equal without white space (``[\\x20\\x09-\\x0D]``); a null text counts
as empty, so nulls, empty texts and texts of white space form one group. Of equal texts the row with
the most code points in the original text stays, then the one with the smallest ``doc_id`` (a null
``doc_id`` loses to any other); of rows that are equal in these too (repeated rows) one arbitrary row
stays. An empty table gives an empty result.

Plan: one scan turns each row into a slim one (id, length, digest), which is written. A frequent-items
sketch (a Misra-Gries summary: ``approx_top_k``) names digests that may be frequent; they are counted
exactly and their winners, ``HEAVY`` at most, are broadcast, so their rows are decided where they lie.
Only the other digests are shuffled, and none of them has more than a few rows for its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._shared import SPACE, documents, free_name, text_or_empty, written

#: Digests that are decided by broadcast; bounds the broadcast to about 100 KB.
HEAVY = 512
#: Counters of the summary: every digest above 1/SLOTS of the rows is found.
SLOTS = 8192
#: Bits of the filter of ids that are dropped: 4 MB, whatever the input.
FILTER = 1 << 25


def digest(text):
    """SHA-256 of the text without white space."""
    return F.sha2(F.encode(F.translate(text, SPACE, ""), "utf-8"), 256)


def heavy_winners(slim: DataFrame, heavy: int = HEAVY, slots: int = SLOTS) -> DataFrame:
    """Digests that the summary reports more than once, with their verified count and winning row.

    At most ``heavy`` rows.
    """
    found = slim.agg(F.expr(f"approx_top_k(sha, {heavy}, {slots})").alias("top"))
    found = found.select(F.explode("top").alias("t")).filter("t.count > 1").select(F.col("t.item").alias("sha"))
    counted = slim.join(F.broadcast(found), "sha").groupBy("sha")
    best = F.max(F.struct("length", F.isnotnull("id"), F.negative("id"), F.negative("at")))
    counted = counted.agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return counted.select(
        "sha", F.negative(F.col("best").getField("col3")).alias("keep_id"), F.negative(F.col("best").getField("col4")).alias("keep_at"), "group_size"
    )


def group_rows(slim: DataFrame, heavy: int = HEAVY, slots: int = SLOTS) -> DataFrame:
    """Each slim row (id, at, length, sha) with ``keep_id``, ``keep_at`` and ``group_size``."""
    winners = written(heavy_winners(slim, heavy, slots).coalesce(1), "winners")
    hot = slim.join(F.broadcast(winners), "sha")
    rest = slim.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    same = W.partitionBy("sha")
    first = same.orderBy(F.desc("length"), F.asc_nulls_last("id"), "at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cold = rest.select(
        "sha", "id", "at", "length", F.first("id").over(first).alias("keep_id"), F.first("at").over(first).alias("keep_at"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return cold.unionByName(hot.select(cold.columns))


def slim_rows(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    t = text_or_empty(text)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.length(t).cast("long").alias("length"), digest(t).alias("sha"))
    return written(rows.withColumn("at", F.monotonically_increasing_id()), "digests")


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", heavy: int = HEAVY, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = group_rows(slim_rows(docs, text, id), heavy, slots)
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", heavy: int = HEAVY, slots: int = SLOTS) -> DataFrame:
    """The rows that stay, with all their columns.

    Decided on the slim rows. A filter of the ids that are dropped or repeated (FILTER bits, broadcast) lets the other rows pass
    where they lie; what it stops is decided by digest, without the rows of frequent digests that are dropped. If the
    filter is full, more rows are shuffled, and the result is the same.
    """
    digests = slim_rows(docs, text, id)
    decided = written(group_rows(digests, heavy, slots), "groups")
    several = decided.filter("group_size > 1")
    sha, keep, place, bits, rank = (free_name(docs, x) for x in ("sha_", "keep_", "place_", "bits_", "rank_"))
    at = F.pmod(F.xxhash64(F.col("id")), F.lit(FILTER)) + 1
    # of a group of rows with one id all but one are dropped too, so every such id is marked
    marks = several.filter("at <> keep_at").select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias(place)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    marks = written(marks.coalesce(1), "marks")
    number = F.pmod(F.xxhash64(F.col(id).cast("long")), F.lit(FILTER)) + 1
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn(place, F.bitmap_bucket_number(number)).join(F.broadcast(marks), place, "left")
    stopped = F.col(id).isNull() | F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    passed = marked.filter(~stopped).select(*[F.col(f"`{c}`") for c in docs.columns])
    t = text_or_empty(text)
    rest = marked.filter(stopped).drop(place, bits).withColumn(sha, digest(t))
    own = F.col(id).cast("long")
    winners = several.filter("at = keep_at").select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(rank), "group_size")
    hot = F.broadcast(written(winners.orderBy(F.desc("group_size"), sha).limit(heavy).drop("group_size"), "hot"))
    rest = rest.join(hot, sha, "left").filter(F.col(rank).isNull() | own.eqNullSafe(F.col(keep))).drop(keep, rank)
    rest = rest.join(winners.drop("group_size"), sha, "left").filter(F.col(rank).isNull() | own.eqNullSafe(F.col(keep)))
    first = W.partitionBy(sha).orderBy(F.desc(F.length(t)))
    rest = rest.withColumn(place, F.row_number().over(first)).filter(F.col(rank).isNull() | (F.col(place) == 1))
    return passed.unionByName(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = """
with d as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) h from documents)
select doc_id, first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = first_value(doc_id) over (partition by h order by n desc, doc_id) as kept, h as text_sha256
from d
"""
