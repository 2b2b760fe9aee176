"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Vectors are scaled to length 1, where nearness by cosine is nearness by distance. Each of TABLES hash
tables cuts the space into cells by ``digits`` projections floor((a.x + b) / width). For a neighbour at
distance R, the chance that it lies in a given cell follows from the normal distribution of a.(x - y);
a query visits cells in the order of that chance until they add up to ``chance``, so all cells of a chance above a bound, which is
found from sorted sums of halves of the digits. So a neighbour within
R is missed by all tables with probability (1 - chance)^TABLES at most, at any size. R is measured against all
vectors: half of PROBED vectors (by hash) have their k-th neighbour within R. Every vector is indexed, and nothing depends on the size
but the number of digits.

What a query's cells hold is compared exactly where it lies, and only the best few go on. Equal
vectors are indexed once, with the smallest k + 1 ids, all that a result can hold. The first digits of a cell
are its group; a query is sent to the groups only that have a cell for it. A group of more than ``CAP`` vectors or ``ASKED`` queries
is dealt to more tasks by hash, on both sides. Queries that found fewer than k are searched again in all vectors, in blocks.

Rows: vectors that are null, empty, all zero, or that hold a null or
non-finite number, take no part, nor do rows with a null id. Vectors of different lengths are no neighbours: each length has
tables of its own. Of repeated ids each row counts as a
candidate of its own, and none for a query of that id; each row of a query's id is a query. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._shared import batched, of_worker, worker_key, written

TABLES, CHANCE, PROBED = 5, 0.45, 128
#: A group of cells has about GROUP vectors; it is split above CAP vectors or ASKED queries.
GROUP, CAP, ASKED = 8192, 32768, 4096
#: Width of a cell, in R; bits that a digit of such a width tells, about.
WIDTH, TOLD = 1.5, 1.5
#: Levels of a digit on either side of a query's own that it may visit.
SIDES = 3


class Hashes:
    """The projections of all tables, for one dimension and R."""

    def __init__(self, dim: int, digits: int, first: int, tables: int, reach: float, seed: int = 29):
        import numpy as np

        random = np.random.default_rng((seed, dim))
        self.dim, self.digits, self.first, self.tables, self.reach = dim, digits, first, tables, max(reach, 1e-3)
        self.width = WIDTH * self.reach
        self.a = random.normal(size=(tables, dim, digits))
        self.b = random.uniform(0, self.width, (tables, digits))
        self.odd = np.random.default_rng(seed).integers(1, 2**62, digits) * 2 + 1

    def places(self, x):
        """[table, vector, digit]: positions in units of the cell width."""
        import numpy as np

        return (np.einsum("nd,tdb->tnb", x, self.a) + self.b[:, None]) / self.width

    def group(self, cells):
        """Number of the group (64-bit hash) of cells, from their first digits and the dimension."""
        import numpy as np

        with np.errstate(over="ignore"):
            z = (cells[..., : self.first].astype(np.int64) * self.odd[: self.first]).sum(axis=-1) + np.int64(self.dim)
            z = (z ^ (z >> 29)) * np.int64(-7046029254386353131)
            return z ^ (z >> 32)

    def levels(self, place):
        """(home, [digit, level]): the log chance of each level around a position."""
        import numpy as np

        home = np.floor(place).astype(np.int64)
        edge = (home[:, None] + np.arange(-SIDES, SIDES + 2) - place[:, None]) * (self.width / self.reach / math.sqrt(2))
        up = np.array([math.erf(e) for e in edge.ravel()]).reshape(edge.shape)
        return home, np.log(np.maximum((up[:, 1:] - up[:, :-1]) / 2, 1e-300))

    def bound(self, levels, chance: float) -> float:
        """The log chance of the last cell that is visited, when cells are visited likeliest first until they add up."""
        import numpy as np

        left, right = sums(levels[: self.digits // 2]), np.sort(sums(levels[self.digits // 2 :]))[::-1]
        total = np.concatenate([[0], np.cumsum(np.exp(right))])
        low, high, weight = -80.0, 0.0, np.exp(left)
        for _ in range(30):
            middle = (low + high) / 2
            if weight @ total[np.searchsorted(-right, left - middle, "right")] >= chance:
                low = middle
            else:
                high = middle
        return low

    def groups(self, home, levels, bound: float):
        """The groups that have a cell above the bound."""
        import numpy as np

        found, prefix = np.zeros(1), np.zeros((1, 0), np.int64)
        for i in range(self.first):
            found = (found[:, None] + levels[i]).ravel()
            prefix = np.concatenate([np.repeat(prefix, levels.shape[1], axis=0), np.tile(home[i] + np.arange(-SIDES, SIDES + 1), len(prefix))[:, None]], axis=1)
            some = found + levels[i + 1 :].max(axis=1).sum() >= bound
            found, prefix = found[some], prefix[some]
        return np.unique(self.group(prefix))

    def visited(self, cells, home, levels, bound: float):
        """Which of the cells (rows of digits) are above the bound."""
        import numpy as np

        at = cells - home + SIDES
        inside = ((at >= 0) & (at <= 2 * SIDES)).all(axis=1)
        chance = levels[np.arange(self.digits), np.clip(at, 0, 2 * SIDES)].sum(axis=1)
        return inside & (chance >= bound)


def sums(levels):
    """The sums of one number of each row, without those that are too small to matter."""
    import numpy as np

    out = np.zeros(1)
    for row in levels:
        out = (out[:, None] + row).ravel()
        out = out[out >= out.max() - 10]
    return out


def usable(rows: DataFrame, vector: str, id: str) -> DataFrame:
    """(id, v): rows that take part, with numbers as double."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return some.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 as 0.0


def unit(column):
    """(vectors, the same of length 1) of an Arrow column of lists of one length."""
    import numpy as np
    import pyarrow.compute as pc

    x = np.array(pc.list_flatten(column)).reshape(len(column), -1)
    largest = np.abs(x).max(axis=1)[:, None]
    u = x / largest
    return x, u / np.sqrt((u * u).sum(1))[:, None]


def by_length(batch, column: int):
    """The parts of a batch with lists of one length in the column."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = np.array(pc.list_value_length(batch.column(column)))
    for length in np.unique(n):
        yield int(length), batch.take(pa.array(np.flatnonzero(n == length)))


def reach(classes: DataFrame, k: int, probed: int = PROBED) -> float:
    """The distance within which half of ``probed`` vectors have k others, among all vectors."""
    import numpy as np

    some = [r["v"] for r in classes.orderBy(F.xxhash64("v"), "v").limit(probed).select("v").collect()]
    by = {n: [i for i, v in enumerate(some) if len(v) == n] for n in {len(v) for v in some}}
    held = {n: (at, np.array([some[i] for i in at])) for n, at in by.items()}
    held = {n: (at, x / np.sqrt((x * x).sum(1))[:, None]) for n, (at, x) in held.items()}

    def run(batches):
        import pyarrow as pa

        best = np.full((len(some), k + 1), -2.0)
        for batch in batches:
            for n, part in by_length(batch, 0):
                if n in held:
                    at, y = held[n]
                    cos = np.concatenate([best[at], y @ unit(part.column(0))[1].T], axis=1)
                    best[at] = np.partition(cos, -k - 1, axis=1)[:, -k - 1 :]
        yield pa.RecordBatch.from_pydict({"probe": pa.array(np.repeat(np.arange(len(some)), k + 1)), "cos": pa.array(best.ravel())})

    found = classes.select("v").mapInArrow(run, "probe long, cos double").filter("cos > -2").groupBy("probe").agg(F.sort_array(F.collect_list("cos"), False).alias("cos"))
    # a vector is the nearest to itself
    cos = [r["c"] if r["c"] is not None else -1.0 for r in found.select(F.get("cos", F.lit(k)).alias("c")).collect()]
    return float(np.sqrt(max(0.0, 2 - 2 * np.median(cos)))) if cos else 2.0


def _search(classes: DataFrame, asked: DataFrame, shape: tuple, k: int, chance: float, cap: int, most: int) -> DataFrame:
    """(ask, id, score): the best k + 1 of the visited cells for each asked vector.

    ``classes`` has (v, ids), ``asked`` (ask, v); ``shape`` is what Hashes take. A chance of 1 visits all cells.
    """
    import numpy as np

    key = worker_key("neighbours")

    def made(dim: int) -> Hashes:
        known = of_worker(key, dict)
        if dim not in known:
            known.clear()
            known[dim] = Hashes(dim, *shape)
        return known[dim]

    tables = 1 if chance >= 1 else shape[2]

    def own(x):
        """A number by which vectors are dealt: of their bytes, so equal in every run."""
        import xxhash

        return np.array([xxhash.xxh32_intdigest(r.tobytes()) >> 1 for r in x], dtype=np.int32)

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, b in by_length(batch, 0):
                hashes = made(dim)
                x, u = unit(b.column(0))
                cells = np.floor(hashes.places(u)).astype(np.int32)
                raw, deal = pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own(x))
                for t in range(tables):
                    group = hashes.group(cells[t]) if chance < 1 else np.full(len(x), dim)
                    digits = pa.array([r.tobytes() for r in cells[t]], pa.binary())
                    yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(b), t, np.int32)), "g": pa.array(group), "deal": deal, "cell": digits, "ids": b.column(1), "v": raw})

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            out: list = [[] for _ in range(6)]
            for dim, b in by_length(batch, 1):
                hashes = made(dim)
                x, u = unit(b.column(1))
                places = hashes.places(u)
                for i, (q, deal) in enumerate(zip(b.column(0).to_pylist(), own(x).tolist())):
                    for t in range(tables):
                        bound, groups = -math.inf, [dim]
                        if chance < 1:
                            home, levels = hashes.levels(places[t, i])
                            bound = hashes.bound(levels, chance)
                            groups = hashes.groups(home, levels, bound).tolist()
                        for g in groups:
                            for column, value in zip(out, (t, g, deal, q, bound, x[i].tobytes())):
                                column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_pydict({n: pa.array(column, kind) for n, kind, column in zip(("t", "g", "deal", "ask", "bound", "v"), kinds, out)})

    rows = classes.select("v", "ids").mapInArrow(index, "t int, g long, deal int, cell binary, ids array<long>, v binary")
    # a small table of queries would be one task, but finding their cells is work
    spread = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks = written(asked.select("ask", "v").repartition(spread, "ask").mapInArrow(ask, "t int, g long, deal int, ask long, bound double, v binary"), "asks")
    # both sides of a large group are dealt to parts, and each part of one side meets each of the other
    sizes = rows.groupBy("t", "g").agg(F.count(F.lit(1)).alias("n")).join(asks.groupBy("t", "g").agg(F.count(F.lit(1)).alias("asked")), ["t", "g"])
    parts = written(sizes.select("t", "g", F.ceil(F.col("n") / cap).cast("int").alias("parts"), F.ceil(F.col("asked") / most).cast("int").alias("asking")), "parts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(parts, ["t", "g"]).withColumn("s", F.pmod("deal", "parts")).withColumn("r", every("asking")).drop("parts", "asking", "deal")
    asks = asks.join(parts, ["t", "g"]).withColumn("r", F.pmod("deal", "asking")).withColumn("s", every("parts")).drop("parts", "asking", "deal")

    def compare(left, right):
        import pyarrow as pa

        out = ([], [], [])
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["v"].to_pylist())).reshape(len(left), -1)
            hashes = made(x.shape[1])
            cells, of = np.unique(np.frombuffer(b"".join(left["cell"].to_pylist()), f"V{4 * hashes.digits}"), return_inverse=True)
            cells = cells.view(np.int32).reshape(len(cells), -1)
            order = np.argsort(of, kind="stable")
            x, starts = x[order], np.searchsorted(of[order], np.arange(len(cells) + 1))
            size = np.diff(starts)
            length, ids, t = np.sqrt((x * x).sum(1)), left["ids"].to_pylist(), left["t"][0].as_py()
            for q, bound, raw in zip(right["ask"].to_pylist(), right["bound"].to_pylist(), right["v"].to_pylist()):
                y = np.frombuffer(raw)
                if bound > -math.inf:
                    u = y / np.sqrt((y * y).sum())
                    home, levels = hashes.levels((u @ hashes.a[t] + hashes.b[t]) / hashes.width)
                    at = np.flatnonzero(np.repeat(hashes.visited(cells, home, levels, bound), size))
                else:
                    at = np.arange(len(x))
                if not len(at):
                    continue
                rough = (x[at] @ y) / length[at]
                if len(at) > k + 1:
                    at = at[rough >= np.partition(rough, -k - 1)[-k - 1] - 1e-9 * abs(rough).max()]
                score = (x[at] * y).sum(1) / (length[at] * math.sqrt(float((y * y).sum())))
                best = sorted((-s, i) for s, c in zip(score.tolist(), at) for i in ids[order[c]])[: k + 1]
                out[0].extend([q] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(-s for s, _ in best)
        return pa.Table.from_pydict({"ask": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    at = ["t", "g", "s", "r"]
    return rows.groupBy(*at).cogroup(asks.groupBy(*at)).applyInArrow(compare, "ask long, id long, score double")


def nearest(rows: DataFrame, query, k: int = 5, vector: str = "embedding", id: str = "vec_id", tables: int = TABLES, chance: float = CHANCE, probed: int = PROBED, cap: int = CAP, asked_cap: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row for which ``query`` (a condition on ``id``) holds."""
    spark = rows.sparkSession
    batched(spark)
    all_ = usable(rows, vector, id)
    first = W.partitionBy("v").orderBy("id")
    few = all_.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    size = classes.count()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    digits = max(1, round(math.log2(size) / TOLD))
    shape = (digits, min(digits - 1, max(0, round(math.log2(size / GROUP) / TOLD))), tables, reach(classes, k, probed))
    # a query's vector is asked about once, however many queries have it
    asks = all_.filter(query(F.col("id"))).select(F.col("id").alias("query_id"), "v")
    asked = asks.groupBy("v").agg(F.min("query_id").alias("ask"))
    asks = written(asks.join(asked, "v").select("query_id", "ask", F.monotonically_increasing_id().alias("row")), "asks")
    asked = written(asked, "asked").select("ask", "v")
    best = W.partitionBy("ask").orderBy(F.desc("score"), "id")

    def searched(some, chance):
        found = _search(classes, some, shape, k, chance, cap, asked_cap).groupBy("ask", "id").agg(F.max("score").alias("score"))
        return written(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "found")

    found = searched(asked, chance)
    # an asked vector has itself among its k + 1 nearest
    short = asked.join(found.groupBy("ask").count().filter(F.col("count") > k).select("ask"), "ask", "left_anti")
    if not short.isEmpty():
        found = found.join(short.select("ask"), "ask", "left_anti").unionByName(searched(short.select("ask", "v"), 1.0))
    out = asks.join(found, "ask").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda id: id % 50 == 0)
