"""Mosaics of series: a few evenly spaced slices of each as one image, by study, written through the image sink."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.operators import previews
from sliceframe.plans.collection import GROUP
from sliceframe.sources import dicom
from sliceframe.sources.images import write_images

SLICES = 5


def shown(series: DataFrame, include_invalid: bool = False) -> DataFrame:
    """Without invalid series, and those that were never validated, unless asked for."""
    return series if include_invalid else series.where(F.coalesce(F.col("status"), F.lit("INVALID")) != "INVALID")


def picks(series: DataFrame, slices: DataFrame, n_slices: int = SLICES) -> DataFrame:
    """A row a picked slice of each series with the path to decode, and what the image says; a series without slices has one row without a place."""
    c = F.col
    name = F.concat(F.right("study_id", F.lit(12)), F.lit("_"), F.right(F.translate("series_id", "./", "__"), F.lit(40)), F.lit("_"), c("plane"), F.lit(".png"))
    title = F.concat_ws(" | ", F.coalesce("series_description", F.lit("(no SeriesDescription)")), F.concat(F.lit("plane="), c("plane")), F.concat(c("n_slices").cast("string"), F.lit(" slices")), F.coalesce("status", F.lit("?")))
    spots = series.select(*GROUP, "n_slices", F.translate(name, "/", "_").alias("name"), title.alias("title"), F.explode_outer(previews.picked(c("n_slices"), n_slices)).alias("place"))
    at = slices.select(*GROUP, c("idx").alias("place"), "path", c("sop_uid"))
    caption = F.concat(F.lit("idx "), c("place").cast("string"), F.lit("/"), (c("n_slices") - 1).cast("string"), F.lit(" "), F.right("sop_uid", F.lit(10)))
    return spots.join(at, [*GROUP, "place"], "left").select(*GROUP, "name", "title", "place", caption.alias("caption"), "path")


def series_mosaics(picked: DataFrame, decoded: DataFrame, *, windowed: bool = False, per_row: int | None = None) -> DataFrame:
    """The images of ``picks`` whose slices ``decoded`` holds by path; a slice that is not there, or could not be decoded, is a crossed tile."""
    there = picked.join(decoded.drop(*[c for c in picked.columns if c != "path"]), "path", "left")
    seen = previews.with_preview(there, windowed=windowed)
    missing = F.when(F.col("preview").isNull() & F.col("place").isNotNull(), F.coalesce("error", F.lit("no such file")))
    return previews.mosaics(seen.select(*GROUP, "name", "title", "place", "caption", "preview", "rows", "columns", missing.alias("error")), per_row)


def visualize_study(spark, series: DataFrame, slices: DataFrame, study_id: str, dest: str, *, n_slices: int = SLICES, include_invalid: bool = False, windowed: bool = False, per_row: int | None = None) -> list[str]:
    """Writes an image for each series of a study to ``dest`` and returns the files' places by name.

    Only the picked slices of this study are read: their paths, ``n_slices`` a series, are what the driver holds.
    """
    mine = F.col("study_id") == study_id
    chosen = picks(shown(series.where(mine), include_invalid), slices.where(mine), n_slices).persist()
    try:
        rows = chosen.select("name", "path").collect()
        paths = sorted({re.sub(r"([\\\[\]{}*?])", r"\\\1", r.path) for r in rows if r.path})
        content = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
        write_images(series_mosaics(chosen, dicom.decoded(content), windowed=windowed, per_row=per_row), dest)
    finally:
        chosen.unpersist()
    return sorted({f"{dest.rstrip('/')}/{r.name}" for r in rows})
