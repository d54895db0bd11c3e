"""Orders over whole columns without gathering a group in one task.

A number's bucket is a fixed, monotone function of it: 256 buckets an octave of
1 + 1024 |x|, so a column of any range has a few thousand. Sums over buckets
are accumulated by group, and exact order is needed only within one bucket. Rows
are read twice: once for the sums, which every task combines, and once for the
values of the few buckets that hold a wanted rank; no other value is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = -(2**62), 2**62
#: Wanted buckets that are sent to every task; more of them (very many groups) meet the values by a shuffle.
SENT = 200_000


def bucket(x: Column) -> Column:
    """Never falls as x rises; null comes first and NaN last, as in Spark's order."""
    x = x.cast("double")
    size = F.floor(F.log2(1 + F.abs(x) * 1024) * F.signum(x) * 256).cast("long")
    infinite = F.when(x > 0, MOST).otherwise(LEAST + 1)
    return F.when(x.isNull(), LEAST).when(F.isnan(x), MOST).when(F.abs(x) == float("inf"), infinite).otherwise(size)


def percentiles(df: DataFrame, by: Sequence[str], value: Column, qs: Sequence[float]) -> DataFrame:
    """(by, q, value): exact percentiles by linear interpolation; groups without a value have no row."""
    by = list(by)
    each = df.select(*by, value.cast("double").alias("_v")).where("_v is not null").withColumn("_b", bucket(F.col("_v")))
    same = by or [F.lit(1)]
    sums = each.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    sums = sums.withColumn("_to", F.sum("_m").over(Window.partitionBy(*same).orderBy("_b"))).withColumn("_all", F.sum("_m").over(Window.partitionBy(*same)))
    at = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    part = lambda q, rank, share: F.struct(F.lit(float(q)).alias("q"), rank.cast("long").alias("rank"), share.alias("share"))
    wanted = [x for q in qs for x in (part(q, F.floor(at(q)), 1 - (at(q) - F.floor(at(q)))), part(q, F.floor(at(q)) + 1, at(q) - F.floor(at(q))))]
    ranks = F.filter(F.array(*wanted), lambda r: (r["share"] > 0) & (r["rank"] >= F.col("_to") - F.col("_m")) & (r["rank"] < F.col("_to")))
    held = sums.withColumn("_r", ranks).where(F.size("_r") > 0).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), (F.col("_to") - F.col("_m")).alias("_from"), "_r")
    meet = F.col("_b") == F.col("_kb")
    for c in by:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    # Without groups there are two buckets a percentile at most; with groups they are counted, and kept, as they are needed twice.
    if not by or (held := held.persist()).count() <= SENT:
        counted = each.join(F.broadcast(held), meet).groupBy(*by, "_v", "_b", "_from", "_r").agg(F.count("*").alias("_n"))
    else:
        counted = each.groupBy(*by, "_v", "_b").agg(F.count("*").alias("_n")).join(held, meet)
    near = counted.withColumn("_end", F.col("_from") + F.sum("_n").over(Window.partitionBy(*same, "_b").orderBy("_v")))
    hit = near.withColumn("_x", F.explode("_r")).where((F.col("_x.rank") < F.col("_end")) & (F.col("_x.rank") >= F.col("_end") - F.col("_n")))
    return hit.groupBy(*by, F.col("_x.q").alias("q")).agg(F.sum(F.col("_x.share") * F.col("_v")).alias("value"))
