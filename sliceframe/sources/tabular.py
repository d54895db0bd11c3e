"""Schema-checked CSV sources: labels, series attributes, test ids, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label columns in order (fixed values).
LABELS = ["ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Medial OA", "Lateral OA", "PF OA", "Effusion", "Synovitis", "Baker's", "Contusion", "Fracture"]
PLANES = ["Axial", "Coronal", "Sagittal"]


class TabularSchemaError(ValueError):
    """A table lacks a required column or holds a value outside its domain."""


def require_columns(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TabularSchemaError(f"{name}: missing columns {missing}")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text (ids must never be read as numbers); quoted fields may span lines."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def numbers(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Typed columns; what is not a number, NaN included, becomes null."""
    def typed(c):
        v = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(v), v).cast(kind)

    return df.withColumns({c: typed(c) for c in columns})


def load_train(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(read_csv(spark, path), ["StudyInstanceUID", *LABELS, "Report"], "train")
    return numbers(df, LABELS, "double")


def load_series(spark: SparkSession, path: str) -> DataFrame:
    cols = ["StudyInstanceUID", "SeriesInstanceUID", "Fluid_Sensitive", "Fat_Suppression", "Anatomical_Plane"]
    df = numbers(require_columns(read_csv(spark, path), cols, "series"), cols[2:4], "int")
    bad = [r[0] for r in df.select("Anatomical_Plane").where(F.col("Anatomical_Plane").isNotNull() & ~F.col("Anatomical_Plane").isin(PLANES)).distinct().limit(5).collect()]
    if bad:
        raise TabularSchemaError(f"series: planes outside {PLANES}: {bad}")
    return df


def load_test(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_csv(spark, path), ["StudyInstanceUID"], "test")


def load_submission(spark: SparkSession, path: str) -> DataFrame:
    return numbers(require_columns(read_csv(spark, path), ["StudyInstanceUID", *LABELS], "submission"), LABELS, "double")
