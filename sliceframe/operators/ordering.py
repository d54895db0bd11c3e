"""Ordering of the rows of a group, gaps between them, rank correlation, picks.

Every function partitions by the same group key, so windows and the following
aggregate share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.vector import dot, slice_normal


def ordering_method(df: DataFrame, group: list[str], position: Column, instance: Column, out: str = "method") -> DataFrame:
    """spatial if all rows of the group have a position, else instance_number if all have a number, else sop_instance_uid."""
    w = Window.partitionBy(*group)
    return df.withColumn(out, F.when(F.bool_and(position.isNotNull()).over(w), "spatial").when(F.bool_and(instance.isNotNull()).over(w), "instance_number").otherwise("sop_instance_uid"))


def order_rows(df: DataFrame, group: list[str], position: Column, instance: Column, uid: Column, *, stage: int = 1) -> DataFrame:
    """Adds method and idx (from 0): spatial by (position, instance or 0, id), else (instance, id), else (id).

    Stage 2 leaves the instance out of the spatial order.
    """
    d = ordering_method(df, group, position, instance)
    spatial = F.col("method") == "spatial"
    second = F.coalesce(instance.cast("long"), F.lit(0).cast("long")) if stage == 1 else F.lit(0).cast("long")
    keys = [F.when(spatial, position), F.when(spatial, second).when(F.col("method") == "instance_number", instance.cast("long")), uid]
    return d.withColumn("idx", F.row_number().over(Window.partitionBy(*group).orderBy(*keys)) - 1)


def slice_positions(headers: DataFrame, group: list[str], *, min_dot: float = 0.99, absolute: bool = True) -> DataFrame:
    """Adds normal and position: IPP along the group's reference normal (first by path), null unless the group is consistent."""
    w = Window.partitionBy(*group)
    first = w.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = headers.withColumn("normal", slice_normal(F.col("iop"))).withColumn("_ref", F.first("normal").over(first))
    agree = dot(F.col("normal"), F.col("_ref"))
    agree = F.abs(agree) >= min_dot if absolute else agree > min_dot
    ready = F.bool_and(F.coalesce(F.col("normal").isNotNull() & (F.size("ipp") == 3) & agree, F.lit(False))).over(w)
    return d.withColumn("position", F.when(ready, dot(F.col("ipp"), F.col("_ref")))).drop("_ref")


def gap_statistics(df: DataFrame, group: list[str], position: Column, order: list[Column], *, epsilon: float = 1e-3, digits: int = 6) -> DataFrame:
    """n, median gap, coefficient of variation (population), gaps below epsilon and span of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.select(*group, position.cast("double").alias("_p"), F.abs(position.cast("double") - F.lag(position.cast("double")).over(w)).alias("_gap"))
    cv = F.try_divide(F.stddev_pop("_gap"), F.avg("_gap"))
    r = lambda x: F.round(x, digits)
    return d.groupBy(*group).agg(
        F.count("*").alias("n"), r(F.median("_gap")).alias("median_gap"), r(F.when(F.avg("_gap") > 0, cv)).alias("gap_cv"),
        F.count_if(F.col("_gap") < epsilon).alias("n_dup"), r(F.max("_p") - F.min("_p")).alias("span"),
    )


def twice_average_rank(group: list[str], value: Column, *, missing_last: bool = False) -> Column:
    """A whole number, as average ranks may end in a half; nulls are equals before all values, or behind them."""
    w = Window.partitionBy(*group)
    peers = F.count("*").over(Window.partitionBy(*group, value))
    return 2 * F.rank().over(w.orderBy(value.asc_nulls_last() if missing_last else value)).cast("long") + peers - 1


def average_rank(group: list[str], value: Column) -> Column:
    return twice_average_rank(group, value) / F.lit(2.0)


def spearman(df: DataFrame, group: list[str], x: Column, y: Column, digits: int = 6, *, missing_last: bool = False) -> DataFrame:
    """Pearson correlation of average ranks; null if either side is constant.

    Rows without y are left out, and those without x, unless ``missing_last`` ranks them behind all others.
    Sums are whole numbers, so that a correlation of zero is zero in any order of the rows and has no direction.
    """
    kept = y.isNotNull() if missing_last else x.isNotNull() & y.isNotNull()
    d = df.where(kept).select(*group, twice_average_rank(group, x, missing_last=missing_last).alias("_x"), twice_average_rank(group, y).alias("_y"))
    total = lambda a, b: F.sum((F.col(a) * F.col(b)).cast("decimal(19,0)"))
    one = d.groupBy(*group).agg(F.count("*").alias("n"), F.sum("_x").cast("decimal(19,0)").alias("s"), total("_x", "_x").alias("xx"), total("_y", "_y").alias("yy"), total("_x", "_y").alias("xy"))
    # Ranks of either side have the same sum.
    central = lambda c: F.col("n").cast("decimal(10,0)") * F.col(c) - F.col("s") * F.col("s")
    one = one.select(*group, "n", *[central(c).cast("double").alias(c) for c in ("xx", "yy", "xy")])
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
    return one.select(*group, "n", F.round(rho, digits).alias("rho"), F.when(rho > 0, "up").when(rho < 0, "down").alias("direction"))


def contiguity(df: DataFrame, group: list[str], number: Column) -> DataFrame:
    n, d = F.count(number), F.count_distinct(number)
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.min(number).cast("long").alias("lo"), F.max(number).cast("long").alias("hi"), F.count_if(number.isNull()).alias("n_missing"),
        (d == n).alias("unique"), ((F.min(number) == 1) & (F.max(number) == F.count("*")) & (d == F.count("*"))).alias("contiguous"),
    )


def first_mid_last(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows 0, n div 2 and n-1 of each group; of colliding labels the later one wins."""
    w = Window.partitionBy(*group)
    d = df.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    pick = F.when(F.col("idx") == F.col("_n") - 1, "last").when(F.col("idx") == F.expr("_n div 2"), "middle").when(F.col("idx") == 0, "first")
    return d.withColumn("pick", pick).where("pick is not null").drop("_n")
