"""A scanned collection: lazily read, scanned once, addressed by study and series."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceframe.plans import collection, visualize
from sliceframe.sources import dicom


class Collection:
    """Headers are read at first use; with ``cache`` they are kept there as Parquet and read back by later runs."""

    def __init__(self, spark: SparkSession, root: str, cache: str | None = None):
        self.spark, self.root, self.cache = spark, root, cache

    @cached_property
    def headers(self) -> DataFrame:
        if self.cache is None:
            return dicom.scan_headers(self.spark, self.root).persist()
        dicom.scan_headers(self.spark, self.root).write.mode("ignore").parquet(self.cache)
        return self.spark.read.parquet(self.cache)

    @cached_property
    def slices(self) -> DataFrame:
        return collection.slice_table(self.headers)

    @cached_property
    def series(self) -> DataFrame:
        return collection.validated(collection.series_table(self.slices))

    def counts(self) -> DataFrame:
        """The scan's counters beside those of studies and series."""
        one = collection.scan_counts(self.series)
        # Two tables of one row each.
        return dicom.scan_counts(self.headers).withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")

    def iter_series(self) -> DataFrame:
        """All series in order of study and series."""
        return self.series.orderBy("study_id", "series_id")

    def study_ids(self) -> DataFrame:
        return self.series.select("study_id").distinct().orderBy("study_id")

    def study(self, study_id: str) -> DataFrame:
        """The series of a study; KeyError if there is none."""
        found = self.series.where(F.col("study_id") == study_id)
        if found.isEmpty():
            raise KeyError(study_id)
        return found.orderBy("series_id")

    def study_summary(self, study_id: str) -> DataFrame:
        return collection.study_summary(self.study(study_id))

    def visualize(self, study_id: str, dest: str, **options) -> list[str]:
        """Images of a study's series; KeyError if there is no such study."""
        return visualize.visualize_study(self.spark, self.study(study_id), self.slices, study_id, dest, **options)

    def export_headers(self, dest: str) -> None:
        """All headers as CSV, and what could not be read, with the scan's counters, as JSON; folders under ``dest`` are replaced."""
        dicom.header_export(self.headers, self.root).write.mode("overwrite").csv(f"{dest}/dicom_headers", header=True, escape='"')
        dicom.issue_report(self.headers).write.mode("overwrite").json(f"{dest}/dicom_header_issues")

    def write_manifests(self, dest: str) -> None:
        collection.write_manifests(self.series, dicom.issues(self.headers), dest, self.root)
