"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A document's size is its number of words. Sources in code point order, null last, weigh 3, 1, 2,
repeating; together they share ``share`` times all words. A source's target stops at ``passes`` times
its words, and what it cannot take is shared again among the others by weight until none is above.

Every source queues its documents, shuffled by a seeded hash, once for each pass, in packets of PACKET words at most (as
networks do, so that a long document does not hold up its source). A packet's virtual finish time is the words
queued by its source up to its end, divided by the source's target. All packets together are put in order of
finish time (then source, then place in the queue) by a range sort, and taken until the total budget, the sum of the targets, is used
up; the packet in which that happens is taken in part. So what is taken is a prefix of the global order, a document
may be taken in part, each source's taken words are within a packet of its target, and no document exceeds ``passes`` times its size.

Null and empty texts have size 0 and take nothing; a null source is a source of its own; repeated rows
queue one by one; an empty table gives an empty result. Very long texts are many packets. Columns of other names are not
looked at. Reruns agree: the order depends only on
doc_id, size and the seed, and rows equal in all these are interchangeable.

Plan: one scan writes slim rows (id, source, size). The running sum in a source does not go through one
task: documents are dealt by (source, slice of the hash), a small table has the sum of each slice, and
its running sum is the offset of the slice. Packets (source number, place, words) are range-sorted; the sums of the ranges tell in which
one the budget ends, and only that one is summed row by row. A queue is served in order, so what the prefix has of each source
(a small table) tells what is taken of each document. Texts are not moved for any of this; ``mix`` joins them to its decisions once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._shared import WORD, documents, free_name, text_or_empty, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
#: Words of a packet.
PACKET = 128
#: Slices of each source's queue; a queue's largest task has 1/SLICES of it.
SLICES = 512
#: Packets of a range of the global order, about.
RANGE = 500_000
SEED = 17


def word_count(text):
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _slim(text: str, source: str, id: str) -> list:
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    return [key, F.col(id).cast("long"), word_count(text_or_empty(text))]


def slim_rows(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """(key, id, words) of each document; the key of a source tells null from any name."""
    return docs.select(*[c.alias(k) for k, c in zip(("key", "id", "words"), _slim(text, source, id))])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(key, queue, size, target) of each source of (key, words); one row for each source, numbered by ``queue``.

    Filling up: with the sources ordered by how soon they are full (passes * size / weight), the first
    k are full and the others take weight * level, where k is the first for which the level does not
    fill source k + 1. All sums are whole numbers, so the result does not depend on their order.
    """
    by = sizes.groupBy("key").agg(F.sum("words").cast("long").alias("size"))
    rank = W.orderBy(F.col("key") == "", "key")
    by = by.withColumn("queue", F.row_number().over(rank))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("queue") - 1) % len(weights) + 1).cast("long"))
    full = F.lit(passes) * F.col("size")
    soon = full / F.col("weight")
    order = W.orderBy(soon, "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    by = by.withColumn("filled", F.sum(full).over(order) - full).withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight"))
    by = by.withColumn("level", (F.sum("size").over(everything) * F.lit(share) - F.col("filled")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= soon, F.struct(soon.alias("soon"), "key", "level"))).over(everything)
    by = by.withColumn("level", first.getField("level"))
    return by.select("key", "queue", "size", F.coalesce(F.least(full.cast("double"), F.col("level") * F.col("weight")), full.cast("double")).alias("target"))


def queued(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, slices: int = SLICES, seed: int = SEED) -> DataFrame:
    """The slim rows, written, with the size, target and number (``queue``) of their source, and ``start``: the words queued before them."""
    draw = F.xxhash64("id", "words", F.lit(seed))
    slim = slim.withColumn("draw", draw).withColumn("slice", F.pmod(F.shiftright("draw", 20), F.lit(slices)).cast("int"))
    sums = written(slim.groupBy("key", "slice").agg(F.sum("words").alias("sum")), "slices")
    ahead = sums.select("key", "slice", (F.sum("sum").over(W.partitionBy("key").orderBy("slice")) - F.col("sum")).alias("ahead"))
    ahead = ahead.join(targets(sums.select("key", F.col("sum").alias("words")), weights, share, passes), "key")
    queue = W.partitionBy("key", "slice").orderBy("draw", "id", "words").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = slim.withColumn("own", F.sum("words").over(queue) - F.col("words")).join(ahead, ["key", "slice"])
    return written(rows.select("key", "id", "words", "size", "target", "queue", (F.col("ahead") + F.col("own")).alias("start")), "queues")


def packets(rows: DataFrame, passes: int = PASSES, packet: int = PACKET) -> DataFrame:
    """(finish, queue, end, words) of the packets of queued rows, with ``start`` as the first word's place in the queue."""
    some = rows.filter((F.col("words") > 0) & (F.col("target") > 0))
    some = some.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    some = some.withColumn("start", F.col("start") + F.col("pass") * F.col("size"))
    some = some.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(packet).cast("long"))))
    length = F.least(F.lit(packet).cast("long"), F.col("words") - F.col("at"))
    end = F.col("start") + F.col("at") + length
    return some.select((end / F.col("target")).alias("finish"), "queue", end.alias("end"), length.alias("words"))


def taken_prefix(rows: DataFrame, passes: int = PASSES, packet: int = PACKET, size: int = RANGE) -> DataFrame:
    """The packets that are taken, in the global order up to the budget; ``words`` of the last one is what is taken of it."""
    spark = rows.sparkSession
    all_ = rows.groupBy("queue", "target").agg(F.sum(F.ceil(F.col("words") / packet)).alias("n"))
    budget, n = all_.agg(F.sum(F.round("target").cast("long")), F.sum("n")).collect()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-passes * int(n or 0) // size))
    order = ["finish", "queue", "end"]
    sorted_ = written(packets(rows, passes, packet).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "packets")
    sums = sorted_.groupBy("range").agg(F.sum("words").alias("sum")).orderBy("range").collect()  # one number a range
    before, last = 0, -1
    for r in sums:
        last = r["range"]
        if before + r["sum"] >= (budget or 0):
            break
        before += r["sum"]
    whole = sorted_.filter(F.col("range") < last).drop("range")
    upto = F.sum("words").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = sorted_.filter(F.col("range") == last).withColumn("left", F.lit((budget or 0) - before).cast("long") - upto + F.col("words")).filter("left > 0")
    return whole.unionByName(edge.withColumn("words", F.least("words", "left")).select(whole.columns))


def decided(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, slices: int = SLICES, seed: int = SEED, packet: int = PACKET) -> DataFrame:
    """(key, id, words, size, target, start, served): the queued rows with the words that are taken of their queue."""
    rows = queued(slim, weights, share, passes, slices, seed)
    served = taken_prefix(rows, passes, packet).groupBy("queue").agg(F.sum("words").alias("served"))
    rows = rows.join(written(served, "served"), "queue", "left")
    return rows.select("key", "id", "words", "size", "target", "start", F.coalesce("served", F.lit(0).cast("long")).alias("served"))


def of_passes(words, size, start, served, passes: int):
    """The words that are taken of a document in each pass."""
    return F.array(*[F.greatest(F.lit(0).cast("long"), F.least(words, served - start - F.lit(i) * size)) for i in range(passes)])


def mixture(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", passes: int = PASSES, **options) -> DataFrame:
    """One row per document, in the order in which the mix first serves it: doc_id, size, source_size, target, taken, finish."""
    rows = decided(written(slim_rows(docs, text, source, id), "sizes"), passes=passes, **options)
    taken = F.aggregate(of_passes(*map(F.col, ("words", "size", "start", "served")), passes), F.lit(0).cast("long"), lambda s, x: s + x)
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("words")) / F.col("target"))
    out = rows.select(F.col("id").alias("doc_id"), F.col("words").alias("size"), F.col("size").alias("source_size"), "target", taken.alias("taken"), finish.alias("finish"))
    return out.orderBy(F.asc_nulls_last("finish"), "doc_id")


def first_words(text, k):
    """The text up to the end of its k-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, k), "")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", n_chars: str = "n_chars", whole: bool = False, passes: int = PASSES, **options) -> DataFrame:
    """The mixed documents with the columns of the input, in no order.

    A document that is taken more than once stands once for each pass; one that is taken in part is
    cut after its last word taken (and ``n_chars``, if there is such a column,
    is that of the cut text). With ``whole`` its service is finished instead: it is taken uncut, so no text
    changes, none that has started is lost, and a source exceeds its target by less than one document.
    """
    rows = decided(written(slim_rows(docs, text, source, id), "sizes"), passes=passes, **options)
    names = {k: free_name(docs, f"mix_{k}") for k in ("key", "id", "null", "words", "size", "start", "served", "taken")}
    n = {k: F.col(x) for k, x in names.items()}
    # rows that are equal in key, id and words stand in a row in the queue, so the first one's place tells those of all
    rows = rows.groupBy("key", "id", "words").agg(F.min("start").alias("start"), F.first("size").alias("size"), F.first("served").alias("served"))
    rows = rows.select(F.coalesce("id", F.lit(-1).cast("long")).alias(names["id"]), F.isnull("id").alias(names["null"]), *[F.col(k).alias(names[k]) for k in ("key", "words", "start", "size", "served")])
    taken = lambda start: F.filter(of_passes(n["words"], n["size"], start, n["served"], passes), lambda x: x > 0)
    rows = rows.filter(F.size(taken(n["start"])) > 0)
    plain, same = [F.col(f"`{c}`") for c in docs.columns], [names[k] for k in ("id", "null", "key", "words")]
    key, own, words = _slim(text, source, id)
    full = docs.select(*plain, F.coalesce(own, F.lit(-1).cast("long")).alias(same[0]), F.isnull(own).alias(same[1]), key.alias(same[2]), words.alias(same[3]))
    row = F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0))) - 1
    out = full.join(rows, same).withColumn(names["start"], n["start"] + row * n["words"])
    out = out.select(*plain, n["words"], F.explode(taken(n["start"])).alias(names["taken"]))
    if whole:
        return out.select(*plain)
    cut = n["taken"] < n["words"]
    changed = {text: F.when(cut, first_words(F.col(text), n["taken"].cast("int"))).otherwise(F.col(text))}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(cut, F.length(changed[text]).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))
