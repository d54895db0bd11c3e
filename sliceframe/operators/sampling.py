"""Evenly spaced centres, triplets by index or by nearest position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.scalar import clip


def sample_locations(n: Column, k: int = 6, margin: float = 0.06, fractions: list[float] | None = None) -> Column:
    """Indexes round_half_even(f (n-1)) without repetition; even fractions are clamped to [1, n-2] where n >= 3."""
    if fractions is not None:
        if any(not 0 <= f <= 1 for f in fractions):
            raise ValueError("sample positions must lie between 0 and 1")
        return F.array_distinct(F.array(*[F.bround(F.lit(float(f)) * (n - 1), 0).cast("int") for f in fractions]))
    m = min(max(margin, 0.0), 0.49)
    even = [m + (1 - 2 * m) * i / (k - 1) if k > 1 else m for i in range(k)]
    at = [F.bround(F.lit(f) * (n - 1), 0).cast("int") for f in even]
    inner = [F.when(n >= 3, clip(a, F.lit(1), (n - 2).cast("int"))).otherwise(clip(a, F.lit(0), (n - 1).cast("int"))) for a in at]
    return F.when(n > 0, F.array_distinct(F.array(*inner)))


def triplets_by_index(df: DataFrame, group: list[str], order: list[Column], value: str, offsets: tuple[int, int, int] = (-1, 0, 1)) -> DataFrame:
    """prev, centre and next values of each row that has all three."""
    if not (offsets[0] < 0 and offsets[1] == 0 and offsets[2] > 0):
        raise ValueError("offsets must be negative, zero, positive")
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.select(*group, (F.row_number().over(w) - 1).alias("idx"), F.lag(value, -offsets[0]).over(w).alias("prev"), F.col(value).alias("centre"), F.lead(value, offsets[2]).over(w).alias("next"))
    return d.where("prev is not null and next is not null")


def nearest_in_window(rows: Column, centre: Column, target: Column) -> Column:
    """idx of the row (idx, pos) nearest to target, ties to the lowest idx; null if it is the centre itself."""
    best = F.array_min(F.transform(rows, lambda r: F.struct(F.abs(r["pos"] - target).alias("d"), r["idx"].alias("idx"))))["idx"]
    return F.when(best != centre, best)


def triplets_by_distance(df: DataFrame, group: list[str], position: Column, order: list[Column], *, step: Column, reach: int = 5) -> DataFrame:
    """Neighbours nearest to position -/+ step within ``reach`` rows; a frame of fixed size, so no self-join."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_pos", position.cast("double")).withColumn("idx", (F.row_number().over(w.orderBy(*order)) - 1).cast("int"))
    d = d.withColumn("_step", step)
    near = F.collect_list(F.struct("idx", F.col("_pos").alias("pos"))).over(w.orderBy("idx").rowsBetween(-reach, reach))
    d = d.withColumn("_near", near)
    d = d.withColumn("prev", nearest_in_window(F.col("_near"), F.col("idx"), F.col("_pos") - F.col("_step"))).withColumn("next", nearest_in_window(F.col("_near"), F.col("idx"), F.col("_pos") + F.col("_step")))
    return d.where("prev is not null and next is not null and prev != next").drop("_near", "_pos", "_step")


def pick_indexes(n: Column, k: int) -> Column:
    """k evenly spaced indexes of 0..n-1, rounded half to even."""
    at = [F.bround(F.lit(i / (k - 1) if k > 1 else 0.0) * (n - 1), 0).cast("int") for i in range(k)]
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array_distinct(F.array(*at)))
