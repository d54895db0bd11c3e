"""Deterministic, leak-free splits by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_ids(df: DataFrame, unit: Column, *, ratio: float = 0.8, seed: int = 42, buckets: int = 256) -> DataFrame:
    """(unit, split): the first floor(n ratio) units by (md5(seed, unit), unit) train, the rest validate.

    Ranks come from prefix counts of hash buckets and a window inside each
    bucket, so no single task orders all units.
    """
    d = df.select(unit.cast("string").alias("unit")).where("unit is not null").distinct()
    d = d.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "unit").cast("binary"))).withColumn("_b", F.substring("_h", 1, 2))
    n = d.groupBy("_b").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "unit")) + F.col("_before")
    # At most 256 buckets.
    return d.join(F.broadcast(n.drop("_n")), "_b").select("unit", F.when(rank <= F.floor(F.col("_all") * F.lit(ratio)), "train").otherwise("val").alias("split"))


def leakage(split: DataFrame) -> DataFrame:
    """Units that stand on both sides."""
    return split.groupBy("unit").agg(F.count_distinct("split").alias("n")).where("n > 1")


def verify_no_leakage(split: DataFrame) -> None:
    if not leakage(split).isEmpty():
        raise ValueError("train and validation units overlap")
