"""Self-join of documents by the Jaccard similarity of their n-gram sets, exact, as components of the links.

Two documents link when ``least``% of the union of their sets is common. Sets are compared in *tiles*. Sizes are cut
into bands; for a pair whose larger set is in a band, ``most`` n-grams at most stand in one set only. All n-gram
hashes are cut into more than ``most`` ranges, so two sets that link are equal in some range: a tile holds the sets of a
band (and those of the band below that are large enough) that are equal, and not empty, in one range. A range has
about five n-grams of a set, so a passage that many documents share does not bring them together, unlike a tile of one n-gram.
A set that has too many empty ranges is cut again by other hashes, until it has not; two sets share the cut
at which the first of them is done. So no link is lost.

A document has a bitmap of parities: bit i tells whether an odd number of its n-grams hash to i. The bits by which two
bitmaps differ bound the n-grams that are not common from below, so the overlap from above; only pairs
that the bound lets pass are compared, by intersecting their sorted arrays of n-gram hashes. As a bitmap of
fixed size says nothing of a long document, those have one of at least two bits an n-gram besides, which is
folded to the other document's size where they differ; it is joined to the pairs that the fixed one lets pass.

Only what the components need is compared. Equal sets are one node. First each tile's nodes are compared with the
tile's smallest node; then, in tiles that still hold several components, nodes of different ones (tiles of the same nodes
count once). So a group of thousands of near copies costs a link each, and no link between components is lost.

N-grams are compared by 64-bit hashes. Words are runs of other than ``[\\x20\\x09-\\x0D]``, with A-Z in
lower case. A document with fewer words than n has its whole sequence as its one n-gram; one without
words (or null) has an empty set and is linked with nothing. Rows with the same id have one
component if their texts differ (a link of one text is a link of the id), and one row each. A row with a null id is linked with nothing, and its component is null. Very long texts
are hashed piece by piece. Columns other than id and text are not looked at. An empty table gives an empty result.

Plan: one scan gives sizes, digests and bitmaps; a second one gives (tile, id), which is the one large shuffle (about a
third of a row for each n-gram). A task sends equal sets to a tile once. Only rows of tiles of two nodes and more go on.
"""

from __future__ import annotations

import bisect
import functools
import math
import operator

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._shared import batched, documents, free_name, of_worker, worker_key, written
from .components import components

#: Words of an n-gram, and the least share of the union, in percent.
WORDS, LEAST = 4, 85
#: Bits of a bitmap (a multiple of 64).
BITS = 1024
#: Sizes from which a document has a bitmap of its own size besides.
LONG = BITS // 2
#: Bits of the filter that picks the texts that are read again: 4 MB, whatever the input.
FILTER = 1 << 25
#: Bytes of a text that are hashed at once.
PIECE = 1 << 18
#: Digests of sets that a task remembers to send equal ones once.
SENT = 200_000
#: Cuts after which a set's empty ranges are sent too.
CUTS = 64


class Sets:
    """Turns a text into the sorted array of its n-grams' hashes.

    A word's hash is a polynomial of its bytes, which differences of running sums give for all words of a piece at once.
    """

    def __init__(self, words: int = WORDS):
        import numpy as np

        random = np.random.default_rng(41)
        odd = random.integers(0, 2**63, words + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words, self.odd, length = words, odd[:words], int(odd[words])
        self.length = [np.uint64(length * k % 2**64) for k in range(words + 1)]
        self.of_length, self.base = odd[words + 1], int(odd[words + 2]) | 3
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = random.integers(0, 2**63, 256, dtype=np.uint64)[lower]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        up, down = np.full(PIECE, self.base, np.uint64), np.full(PIECE, pow(self.base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def _piece(self, raw):
        """(start, end, polynomial) of the words of at most PIECE bytes."""
        import numpy as np

        solid = np.empty(len(raw) + 2, np.int8)
        solid[0] = solid[-1] = 0
        np.logical_not(self.space[raw], out=solid[1:-1], casting="unsafe")
        turn = np.flatnonzero(np.diff(solid))
        start, end = turn[::2], turn[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=sums[1:])
        return start, end, (sums[end] - sums[start]) * self.down[start]

    def hashes(self, text: str | None):
        """The hash of each word."""
        import numpy as np

        raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
        if len(raw) <= PIECE:
            start, end, value = self._piece(raw)
            length = (end - start).astype(np.uint64)
        else:
            lengths, values, open_ = [], [], False
            for at in range(0, len(raw), PIECE):
                part = raw[at : at + PIECE]
                start, end, value = self._piece(part)
                length = (end - start).astype(np.uint64)
                if open_ and len(start) and not start[0]:
                    # the first word here goes on from the piece before
                    before = lengths[-1]
                    values[-1][-1:] += value[:1] * np.uint64(pow(self.base, int(before[-1]), 2**64))
                    before[-1] += length[0]
                    value, length = value[1:], length[1:]
                if len(value):
                    lengths.append(length)
                    values.append(value)
                open_ = len(end) > 0 and end[-1] == len(part)
            length, value = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (lengths, values))
        h = value + length * self.of_length
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def __call__(self, text: str | None):
        import numpy as np

        h = self.hashes(text)
        k = min(self.words, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        z = h[:n] * self.odd[0]
        for i in range(1, k):
            z = z + h[i : i + n] * self.odd[i]
        z = z + self.length[k]
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = np.sort(z ^ (z >> np.uint64(29)))
        return z[np.concatenate(([True], z[1:] != z[:-1]))]


class Tiles:
    """The tiles of a set."""

    def __init__(self, least: int):
        self.least, self.first = least, [1]
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        """Bands are as wide as two steps by the largest ratio of sizes that link."""
        while self.first[-1] <= n:
            self.first.append(max(self.first[-1] + 1, self.first[-1] * 10_000 // self.least**2))
        return bisect.bisect_right(self.first, n) - 1

    def ranges(self, band: int) -> tuple[int, int]:
        """(ranges, empty ones that a set may have) for pairs whose larger set is in the band.

        Sets that link differ in so many ranges at most; of the others more than the empty ones that are allowed are equal.
        As many are allowed as make three of four of the smallest sets fit.
        """
        found = self.known.get(band)
        if found is None:
            self.band(self.first[-1] if len(self.first) <= band + 1 else 1)
            low, high = self.first[band], self.first[band + 1] - 1
            most = 2 * high * (100 - self.least) // (100 + self.least)
            smallest, empty = max(1, -(-self.least * low // 100)), 0
            while most and empty <= most:
                n = most + 1 + empty
                mean = n * math.exp(smallest * math.log1p(-1 / n))
                if sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(empty + 1)) >= 0.75:
                    break
                empty += 1
            found = self.known[band] = most + 1 + empty, empty
        return found

    def __call__(self, z):
        """The tiles of a sorted array of hashes, as 64-bit numbers."""
        import numpy as np

        out, own = [], self.band(len(z))
        # sets that link with this one can be in the band above
        for band in range(own, self.band(100 * len(z) // self.least) + 1):
            n, allowed = self.ranges(band)
            for cut in range(CUTS):
                if cut:
                    x = z * np.uint64((2 * cut + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    x = np.sort(x ^ (x >> np.uint64(31)))
                else:
                    x = z
                at = ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
                start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                tile = np.add.reduceat(x, start) * np.uint64(0xD6E8FEB86659FD93) + at[start]
                tile = (tile ^ (tile >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25) + np.uint64(band * CUTS + cut)
                out.append(tile ^ (tile >> np.uint64(28)))
                if n - len(start) <= allowed:
                    break
            else:
                # equal empty ranges are all that two such sets may share
                bare = np.setdiff1d(np.arange(n, dtype=np.uint64), at) * np.uint64(0x9FB21C651E98DF25) + np.uint64(band)
                out.append(bare ^ (bare >> np.uint64(28)))
        return np.concatenate(out)


def parities(z, bits: int):
    """Bit i tells whether an odd number of the hashes have the rest i; a power of 2."""
    import numpy as np

    return np.packbits((np.bincount((z & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits by which two bitmaps differ, the wider one folded to the other's size."""
    import numpy as np

    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def features(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, same, bits, wide) of (id, text): size, digest of the set, bitmaps."""
    import numpy as np

    key = worker_key("sets")

    def run(batches):
        import pyarrow as pa
        import xxhash

        sets = of_worker(key, lambda: Sets(words))
        for batch in batches:
            n, same, bits, wide = [], [], [np.zeros(0, np.int64)], []
            for t in batch.column(1):
                z = sets(t.as_py())
                n.append(len(z))
                same.append(xxhash.xxh3_128_digest(z.tobytes()))
                bits.append(parities(z, BITS).view(np.int64))
                wide.append(parities(z, 1 << (2 * len(z) - 1).bit_length()).tobytes() if len(z) >= LONG else None)
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": pa.array(n, pa.int64()), "same": pa.array(same, pa.binary()), "bits": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits))), "wide": pa.array(wide, pa.binary())})

    return docs.mapInArrow(run, "id long, n long, same binary, bits array<long>, wide binary")


def tiled(docs: DataFrame, words: int, least: int) -> DataFrame:
    """(tile, id) of (id, text). Of equal sets that a task meets, one is sent."""
    import numpy as np

    key = worker_key("sets")

    def run(batches):
        import pyarrow as pa
        import xxhash

        sets, tiles, sent = of_worker(key, lambda: Sets(words)), Tiles(least), set()
        for batch in batches:
            out, of, held = [], [], 0
            for id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                z = sets(t.as_py())
                same = xxhash.xxh3_128_digest(z.tobytes())
                if len(z) and same not in sent:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(same)
                    out.append(tiles(z).view(np.int64))
                    of.append(np.full(len(out[-1]), id))
                    held += len(out[-1])
                if held >= 1 << 17:
                    yield pa.RecordBatch.from_pydict({"tile": pa.array(np.concatenate(out)), "id": pa.array(np.concatenate(of))})
                    out, of, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"tile": pa.array(np.concatenate(out)), "id": pa.array(np.concatenate(of))})

    return docs.mapInArrow(run, "tile long, id long")


def may_link(na, nb, a, b, least: int):
    """Whether sizes and bitmaps allow a link: overlap <= (na + nb - differing bits) / 2."""
    differing = functools.reduce(operator.add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)])
    return sizes_allow(na, nb, least) & ((100 + least) * (na + nb - differing) >= 2 * least * (na + nb))


def sizes_allow(na, nb, least: int):
    return least * F.greatest(na, nb) <= 100 * F.least(na, nb)


def wide_allows(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) without those whose wide bitmaps rule out a link; pairs with a short document stay."""

    @F.arrow_udf("boolean")
    def allowed(total, a, b):
        import pyarrow as pa

        sides = zip(total.to_pylist(), a.to_pylist(), b.to_pylist())
        return pa.array([x is None or y is None or (100 + least) * (n - differing_bits(x, y)) >= 2 * least * n for n, x, y in sides], pa.bool_())

    long = nodes.filter(F.col("n") >= LONG)
    sides = [long.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]
    total = F.coalesce(F.col("na") + F.col("nb"), F.lit(0).cast("long"))
    return pairs.join(sides[0], "a", "left").join(sides[1], "b", "left").filter(allowed(total, "wa", "wb")).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, words: int, least: int) -> DataFrame:
    """The pairs (a, b) of ids that link, by their sets. Only texts of these ids, and few others, are turned into sets again."""
    import numpy as np

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    # from 1 on: bitmap buckets start at 1, but that of 0 is 0
    place = lambda id: F.pmod(F.xxhash64(id), F.lit(FILTER)) + 1
    marks = ids.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(FILTER // 8 + 4096, np.uint8)
    for r in marks.toLocalIterator():
        at = (r["k"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(bits) - at]
    first = int(bitmap_first(docs.sparkSession))
    held, key = docs.sparkSession.sparkContext.broadcast(bits), worker_key("sets")

    def run(batches):
        import pyarrow as pa

        sets, marks = of_worker(key, lambda: Sets(words)), held.value
        for batch in batches:
            p = np.array(batch.column(2)) - first
            hit = np.flatnonzero(marks[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            for part in range(0, len(hit), 256):
                some = pa.array(hit[part : part + 256])
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(some), "grams": pa.array([sets(t.as_py()).tobytes() for t in batch.column(1).take(some)], pa.binary())})

    sets = docs.select("id", "text", place("id").alias("p")).mapInArrow(run, "id long, grams binary")

    @F.arrow_udf("boolean")
    def enough(a, b):
        import pyarrow as pa

        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= least * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    one = pairs.join(sets.withColumnsRenamed({"id": "a", "grams": "ga"}), "a")
    two = one.join(sets.withColumnsRenamed({"id": "b", "grams": "gb"}), "b")
    out = written(two.filter(enough("ga", "gb")).select("a", "b").distinct(), "linked")
    held.unpersist()
    return out


def bitmap_first(spark: SparkSession) -> int:
    """The value of the first bit of the first bucket."""
    return spark.range(1).select(F.bitmap_bucket_number(F.lit(1).cast("long")).alias("k"), F.bitmap_bit_position(F.lit(1).cast("long")).alias("p")).selectExpr("1 - p - (k - 1) * 32768 as f").collect()[0]["f"]


def similar_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach."""
    batched(docs.sparkSession)
    all_ = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = all_.filter(F.col("id").isNotNull())
    found = written(features(all_, words), "features")
    some = found.filter("n > 0 and id is not null")
    # of equal sets the smallest id is the node
    named = written(some.select("id", "same").join(some.groupBy("same").agg(F.min("id").alias("node")), "same").select("id", "node", "same"), "named")
    of = W.partitionBy("tile")
    tiles = tiled(rows, words, least).withColumn("p", F.min("id").over(of)).withColumn("q", F.max("id").over(of)).filter("p < q").select("tile", "id")
    tiles = written(tiles.join(named.select("id", "node"), "id").select("tile", "node").distinct(), "tiles")
    # each node of a tile with the smallest one
    pivots = tiles.groupBy("tile").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("tile", "a")
    first = tiles.join(pivots, "tile").filter("a < node").select("a", F.col("node").alias("b")).distinct()
    sides = [some.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"m{x}")) for x in "ab"]
    first = first.join(sides[0], "a").join(sides[1], "b").filter(may_link(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), least)).select("a", "b")
    first = written(wide_allows(first, some, least), "pairs")
    links = linked(first, rows, words, least)
    label = components(links)
    # tiles that still hold several components; those of the same nodes once
    rest = tiles.join(label, "node", "left").select("tile", "node", F.coalesce("component", "node").alias("component"))
    nodes = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"t{k}") for k in (0, 1)]
    several = rest.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("t2"), *nodes).filter("x < y").drop("x", "y")
    rest = rest.join(several, "tile").select("t0", "t1", "t2", "node", "component").distinct()
    rest = written(rest.join(some.select(F.col("id").alias("node"), "n", "bits"), "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    at = functools.reduce(operator.and_, [F.col(f"x.t{k}") == F.col(f"y.t{k}") for k in (0, 1, 2)])
    at &= (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    second = x.join(y, at & may_link(F.col("x.n"), F.col("y.n"), F.col("x.bits"), F.col("y.bits"), least)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    second = written(wide_allows(second.join(first, ["a", "b"], "left_anti"), some, least), "more")
    if not second.isEmpty():
        links = links.unionByName(linked(second, rows, words, least))
        label = components(links)
    node = named.select("same", "node").distinct().join(label, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    out = found.select("id", "n", "same").join(node, "same", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The documents without those that are not the smallest id of their component; all columns stay.

    Of an id that several rows have, all rows stay if one of them does; rows with a null id stay.
    """
    gone = free_name(docs, "gone_")
    groups = similar_groups(docs, text, id, words, least).groupBy(F.col("doc_id").alias(gone)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    return docs.join(groups.filter("not stays").select(gone), F.col(id).cast("long") == F.col(gone), "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) + any_value(b.n) as n from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * c >= 85 * (n - c)),
e as (select a, b from l union all select b, a from l),
r(node, reached) as (select doc_id, doc_id from documents union select r.node, e.b from r join e on r.reached = e.a)
select doc_id, len(s)::bigint as n_shingles, (select min(reached) from r where node = doc_id) as component_id from s
"""
