"""Connected components by alternating large and small stars, on DataFrames.

Every round replaces edges by edges to smaller neighbours; a hot centre is only
a hot join key, which adaptive execution splits. Rounds are cut off in the
shared checkpoint folder, and a fixed point is recognised by a digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root) for all nodes that are not their component's smallest."""
    e = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        e = durable(small_star(large_star(e)))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
