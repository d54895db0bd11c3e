"""Tables as text files and the sample cache, on any file system that Spark writes.

CSV has no arrays or structs, so those columns travel as JSON text.
"""

from __future__ import annotations

import logging
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)
log = logging.getLogger(__name__)
SPLITS = ("train", "val")
#: Digits of a key that name the folder of its entries.
PREFIX = 2


def export_csv(df: DataFrame, dest: str) -> None:
    df.select(*[F.to_json(f"`{f.name}`", {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f"`{f.name}`") for f in df.schema]).write.mode("overwrite").csv(dest, header=True, escape='"')


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``export_csv`` wrote; nothing is inferred, so identifiers of digits stay text. An empty text comes back as null, as CSV headers have it."""
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, NESTED) else f.dataType) for f in schema])
    raw = spark.read.csv(path, header=True, schema=flat, escape='"', multiLine=True, enforceSchema=False)
    return raw.select(*[F.from_json(f"`{f.name}`", f.dataType).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f"`{f.name}`") for f in schema])


def write_report(df: DataFrame, dest: str) -> None:
    """A report as JSON lines with its nulls. Reports are aggregates of bounded size, so one file is written."""
    df.coalesce(1).write.mode("overwrite").json(dest, ignoreNullFields=False)


def write_split(split: DataFrame, dest: str, unit: str = "unit", column: str = "StudyInstanceUID") -> None:
    """(unit, split) to a CSV folder for each side."""
    for side in SPLITS:
        split.where(F.col("split") == side).select(F.col(unit).alias(column)).write.mode("overwrite").csv(f"{dest}/{side}.csv", header=True)


def read_split(spark: SparkSession, dest: str, unit: str = "unit", column: str = "StudyInstanceUID") -> DataFrame:
    sides = [spark.read.csv(f"{dest}/{side}.csv", header=True, schema=f"{column} string").select(F.col(column).alias(unit), F.lit(side).alias("split")) for side in SPLITS]
    return sides[0].unionByName(sides[1])


def cache_put(samples: DataFrame, path: str) -> None:
    """Adds rows with a ``cache_key`` as entries, a row of any columns each. An entry says how many rows it has and what they hash to, and when it was stored; readers see all of a job's files or none."""
    w = Window.partitionBy("cache_key")
    row = F.struct(*[F.col(f"`{c}`") for c in samples.columns])
    entries = samples.select(row.alias("row"), F.col("cache_key")).withColumns({"entry_rows": F.count("*").over(w), "digest": F.xxhash64("row"), "stored_at": F.lit(time.time_ns())})
    entries.select("*", F.substring("cache_key", 1, PREFIX).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(f"{path}/entries")


def cache_drop(keys: DataFrame, path: str) -> None:
    """Invalidates entries by ``cache_key``: those stored until now are not found any more. Nothing is rewritten, so readers are not disturbed."""
    keys.select("cache_key", F.lit(time.time_ns()).alias("dropped_at")).distinct().write.mode("append").parquet(f"{path}/dropped")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    read = spark.read.option("ignoreCorruptFiles", "true")
    try:
        return read.schema(read.parquet(path).schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cache_get(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all whole entries, of a key stored twice the latest; None where there is no cache.

    An entry that has lost rows, or whose rows don't hash to what was stored, is a miss; how many are is logged as a warning.
    """
    entries = _table(spark, f"{path}/entries")
    if entries is None:
        return None
    dropped = _table(spark, f"{path}/dropped")
    good = F.coalesce(F.count_if(F.xxhash64("row") == F.col("digest")) == F.max("entry_rows"), F.lit(False))
    each = entries.groupBy("cache_key", "stored_at").agg(good.alias("whole"))
    if dropped is not None:
        last = dropped.groupBy("cache_key").agg(F.max("dropped_at").alias("dropped_at"))
        each = each.join(last, "cache_key", "left").where("dropped_at is null or stored_at > dropped_at").drop("dropped_at")
    if bad := each.where("not whole").count():
        log.warning("%d entries of the sample cache are damaged and count as misses", bad)
    latest = each.where("whole").groupBy("cache_key").agg(F.max("stored_at").alias("stored_at"))
    return entries.join(latest, ["cache_key", "stored_at"], "left_semi").select("row.*")


def cache_misses(keys: DataFrame, path: str) -> DataFrame:
    """Rows of ``keys`` whose ``cache_key`` is not in the cache; all of them where there is no cache yet."""
    have = cache_get(keys.sparkSession, path)
    return keys if have is None else keys.join(have.select("cache_key").distinct(), "cache_key", "left_anti")
