"""Connected components of links by alternating large and small stars; nothing goes to the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links: the smallest node that links reach.

    Links from a node to itself and repeated ones count as nothing; an empty table gives an empty result.
    A hot node costs one row a link: the minimum is taken before the shuffle as well.
    """
    at = written(links.select(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y")).filter("x <> y").distinct(), "links")
    seen = None
    while True:
        # every node's larger neighbours go to the smallest node that it knows
        both = at.unionByName(at.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # then every node and its smaller neighbours
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        at = written(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "stars")
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).collect()[0]
        if now == seen or not now[0]:
            break
        seen = now
    return at.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(at.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
