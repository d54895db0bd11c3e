"""Aggregations over label tables and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.scalar import safe_ratio
from sliceframe.operators.ranks import percentiles


def long_labels(df: DataFrame, labels: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep.., idx, label, y): one row a label; NaN is unlabelled like null."""
    y = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("label"), y(c).alias("y")) for i, c in enumerate(labels)])
    return df.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")


def label_statistics(df: DataFrame, labels: list[str]) -> DataFrame:
    """Counts and prevalence of each label; null means unlabelled, never negative."""
    pos = F.count_if(F.col("y") > 0)
    return long_labels(df, labels).groupBy("label").agg(
        F.count("*").alias("total"), F.count("y").alias("labeled"), pos.alias("positive"),
        F.count_if(F.col("y") == 0).alias("negative"), F.count_if(F.col("y").isNull()).alias("missing"),
        F.round(safe_ratio(pos, F.count("y")), 6).alias("prevalence"),
    )


def cooccurrence(df: DataFrame, labels: list[str], threshold: float = 0.0) -> DataFrame:
    """Joint positives of every pair of labels, zeros included, from one aggregate over the wide rows."""
    cells = [F.count_if((F.col(f"`{a}`") > threshold) & (F.col(f"`{b}`") > threshold)).alias(f"c{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    one = df.agg(*cells)
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}_{j}").alias("joint")) for i, a in enumerate(labels) for j, b in enumerate(labels)])
    return one.select(F.explode(grid).alias("r")).select("r.*")


def jaccard(df: DataFrame, labels: list[str]) -> DataFrame:
    joint = cooccurrence(df, labels)
    pos = joint.where("a = b").select(F.col("a").alias("k"), F.col("joint").alias("n"))
    pairs = joint.where("a < b").join(pos.toDF("a", "n_a"), "a").join(pos.toDF("b", "n_b"), "b")
    return pairs.select("a", "b", "joint", F.round(safe_ratio(F.col("joint"), F.col("n_a") + F.col("n_b") - F.col("joint")), 6).alias("jaccard"))


def describe(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """n, mean, population std, min, p1, p25, median, p75, p99, max; exact percentiles by linear interpolation."""
    c = F.col(f"`{column}`").cast("double")
    names = {0.01: "p1", 0.25: "p25", 0.5: "median", 0.75: "p75", 0.99: "p99"}
    r = lambda x: F.round(x, digits)
    one = df.agg(F.count(c).alias("n"), r(F.avg(c)).alias("mean"), r(F.stddev_pop(c)).alias("std"), r(F.min(c)).alias("min"), r(F.max(c)).alias("max"))
    ranked = percentiles(df, [], c, list(names)).agg(*[r(F.max(F.when(F.col("q") == q, F.col("value")))).alias(n) for q, n in names.items()])
    both = one.unionByName(ranked, allowMissingColumns=True)
    return both.agg(*[F.max(k).alias(k) for k in ("n", "mean", "std", "min", *names.values(), "max")])


def value_counts(df: DataFrame, *columns: str, top: int | None = None) -> DataFrame:
    """Counts of non-null values; ties of a top list go by value."""
    out = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), *columns).limit(top)


def histogram(df: DataFrame, group: str, value: Column, name: str = "k") -> DataFrame:
    """How many groups have each value of an aggregate."""
    return df.groupBy(group).agg(value.alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key; equal nulls are duplicates. Texts are told apart by their SHA-256, so that none is a shuffle key."""
    long = lambda k: df.schema[k].dataType.simpleString() in ("string", "binary")
    own = [F.sha2(F.col(f"`{k}`").cast("binary"), 256) if long(k) else F.col(f"`{k}`") for k in keys]
    one = df.select(*[c.alias(f"k{i}") for i, c in enumerate(own)]).groupBy(*[f"k{i}" for i in range(len(own))]).agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in columns])).alias("r")).select("r.*").where("n_null > 0")


def majority(df: DataFrame, group: str, value: Column, order: list[Column]) -> DataFrame:
    """Most frequent non-empty value, trimmed and upper-cased; ties go to the first seen."""
    v = F.upper(F.trim(value))
    seen = df.select(group, v.alias("value"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]).where("value != ''")
    first = F.min(F.struct(*[f"_o{i}" for i in range(len(order))]))
    each = seen.groupBy(group, "value").agg(F.count("*").alias("n"), first.alias("first"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), "first")
    return each.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(group, "value", "n")


def content_duplicates(df: DataFrame, content: Column, key: str, examples: int = 5) -> DataFrame:
    """Groups of equal content by SHA-256, with their size and the ``examples`` smallest keys.

    Keys are ranked with a limit, which Spark applies in each task before it sends rows, so no task holds a large group.
    """
    h = df.select(F.sha2(content.cast("binary"), 256).alias("sha256"), F.col(key).alias("key"))
    n = h.groupBy("sha256").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")
    first = h.withColumn("_k", F.row_number().over(Window.partitionBy("sha256").orderBy("key"))).where(F.col("_k") <= examples)
    return n.join(first.groupBy("sha256").agg(F.array_sort(F.collect_list("key")).alias("examples")), "sha256")


def multi_valued(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one distinct value."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")
