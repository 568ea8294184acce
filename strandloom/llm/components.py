"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and a join, so links stay distributed; a step's result is
checkpointed to the shared folder. The number of steps grows with the logarithm of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import checkpointed


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def roots(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of links (a, b bigint) that isn't its own root."""
    e = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node above its neighbours points to its least one in `large`; those neighbours follow
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
