"""From header rows to ordered slices, validated series, study summaries and manifests.

All steps share one partitioning by study and series, so that a scan is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.vector import dot, plane_of
from sliceframe.operators.ordering import order_rows, slice_positions
from sliceframe.operators.quality import apply_rules, stage1_rules, stage1_sentences

GROUP = ["study_id", "series_id"]
#: What the manifest takes from a series' first ordered slice, and under which name.
FIRST = {
    "SeriesDescription": "series_description", "SeriesNumber": "series_number", "Modality": "modality", "BodyPartExamined": "body_part_examined", "ProtocolName": "protocol_name",
    "SequenceName": "sequence_name", "Rows": "rows", "Columns": "columns", "spacing": "pixel_spacing", "SliceThickness": "slice_thickness", "iop": "orientation",
    "TransferSyntaxUID": "transfer_syntax_uid", "SpacingBetweenSlices": "spacing_tag", "path": "example_path",
}


def keyed(headers: DataFrame) -> DataFrame:
    """Headers with the keys of their study and series."""
    return headers.withColumns({"study_id": F.coalesce("StudyInstanceUID", F.lit("MISSING_STUDY")), "series_id": F.coalesce("SeriesInstanceUID", F.lit("MISSING_SERIES"))})


def slice_table(headers: DataFrame) -> DataFrame:
    """Valid headers with group keys, usable geometry, position, method and idx (from 0)."""
    c = F.col
    d = headers if "read_error" in headers.columns else headers.withColumn("read_error", F.lit(None).cast("string"))
    d = keyed(d.where("kind = 'dicom'")).withColumns({
        "sop_uid": F.coalesce(c("SOPInstanceUID"), F.concat(F.lit("MISSING_SOP::"), c("path"))),
        "iop": F.when(F.size("ImageOrientationPatient") >= 6, F.slice("ImageOrientationPatient", 1, 6)),
        "ipp": F.when(F.size("ImagePositionPatient") == 3, c("ImagePositionPatient")),
        "spacing": F.when(F.size("PixelSpacing") >= 2, F.slice("PixelSpacing", 1, 2)),
    })
    return order_rows(slice_positions(d, GROUP), GROUP, F.col("position"), F.col("InstanceNumber"), F.col("sop_uid"))


def series_table(slices: DataFrame, *, epsilon: float = 1e-3) -> DataFrame:
    """A row a series: counts that the rules judge, and what the manifest shows."""
    c = F.col
    w = Window.partitionBy(*GROUP).orderBy("idx")
    to_first = F.array_max(F.zip_with("iop", F.first("iop").over(w), lambda a, b: F.abs(a - b)))
    # Without a spatial order, positions are those along the first ordered slice's normal, if every slice has one.
    place = F.when(c("method") == "spatial", c("position")).otherwise(dot(c("ipp"), F.first("normal").over(w)))
    d = slices.withColumns({"_place": place, "_turn": to_first}).withColumn("_gap", F.abs(c("_place") - F.lag("_place").over(w)))
    known = F.count_if(c("_place").isNull()) == 0
    missing = lambda x: F.count_if(x.isNull())
    # 2 stands for more than one: rules ask no more, and counts of distinct values would multiply the rows.
    kinds = lambda x: F.when(F.min(x) != F.max(x), 2).when(F.min(x).isNotNull(), 1).otherwise(0)
    one = d.groupBy(*GROUP).agg(
        F.count("*").alias("n_slices"), F.first("method").alias("method"), F.min_by("normal", "idx").alias("_normal"),
        *[F.get(F.min_by(F.array(k), "idx"), F.lit(0)).alias(v) for k, v in FIRST.items()],
        F.count_if(c("Rows").isNull() | c("Columns").isNull()).alias("n_no_size"), F.greatest(kinds(c("Rows")), kinds(c("Columns"))).alias("n_sizes"),
        missing(c("spacing")).alias("n_no_spacing"), kinds(c("spacing")).alias("n_spacings"), missing(c("iop")).alias("n_no_iop"), F.max("_turn").alias("iop_spread"),
        missing(c("ipp")).alias("n_no_ipp"), missing(c("_place")).alias("n_no_position"), F.when(known, F.count_if(c("_gap") < epsilon)).otherwise(0).alias("n_dup"), F.when(known, F.median("_gap")).alias("median_gap"),
        F.when(known & (F.avg("_gap") > 0), F.stddev_pop("_gap") / F.nullif(F.avg("_gap"), F.lit(0.0))).alias("gap_cv"),
        *[F.array_sort(F.collect_set(k)).alias(v) for k, v in {"Rows": "all_rows", "Columns": "all_columns", "spacing": "all_spacings", "TransferSyntaxUID": "all_syntaxes"}.items()], F.array_sort(F.collect_set(F.when(c("NumberOfFrames") > 1, c("NumberOfFrames")))).alias("all_frames"),
        F.count("read_error").alias("n_unreadable"), F.min_by("read_error", F.when(c("read_error").isNotNull(), c("idx"))).alias("first_error"), F.count_if(c("NumberOfFrames") > 1).alias("n_multiframe"), kinds(F.coalesce(c("TransferSyntaxUID"), F.lit(""))).alias("n_syntaxes"),
    )
    # Of a series that is not spatially ready the plane is unknown.
    plane = F.when(c("method") == "spatial", plane_of(c("_normal"))).otherwise("unknown")
    return one.withColumn("plane", plane).withColumn("slice_spacing", F.coalesce("median_gap", "spacing_tag")).drop("_normal")


def with_unscanned(series: DataFrame, listed: DataFrame) -> DataFrame:
    """``series`` and a row without slices for each listed one (study_id, series_id) that no header names."""
    there = series.select(*GROUP)
    return series.unionByName(listed.select(*GROUP).distinct().join(there, GROUP, "left_anti").withColumns({"n_slices": F.lit(0).cast("long"), "plane": F.lit("unknown")}), allowMissingColumns=True)


def validated(series: DataFrame, **limits) -> DataFrame:
    """Series with their status, codes, and a sentence for each code. One without slices has no other finding than that."""
    done = apply_rules(series, stage1_rules(**limits))
    done = done.withColumn("codes", F.when(F.col("n_slices") == 0, F.array(F.lit("empty_series"))).otherwise(F.col("codes")))
    said = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in stage1_sentences(**{k: v for k, v in limits.items() if k != "max_tag"}).items()]))
    messages = F.transform("codes", lambda k: F.element_at("_said", k))
    # Bound once a row: in the lambda the map would be made again for each code.
    return done.withColumn("_said", said).withColumn("messages", F.when(F.size("codes") == 0, F.array(F.lit("all inspected checks passed"))).otherwise(messages)).drop("_said")


def manifest(checked: DataFrame, root: str = "") -> DataFrame:
    """A row a series, without pixels; vectors as JSON text so that it can be written as CSV."""
    c = F.col
    below = F.regexp_replace(F.replace(c("example_path"), F.lit(root.rstrip("/") + "/"), F.lit("")), "^file:/*(?!/)", "") if root else c("example_path")
    return checked.select(
        *GROUP, "series_description", "series_number", "modality", "body_part_examined", "protocol_name", "sequence_name", "plane", c("n_slices").alias("slice_count"), "rows", "columns",
        F.to_json("pixel_spacing").alias("pixel_spacing"), "slice_spacing", "slice_thickness", F.to_json("orientation").alias("orientation"), "transfer_syntax_uid", c("method").alias("ordering_method"),
        c("status").alias("validation_status"), F.array_join("messages", " | ").alias("validation_messages"), F.regexp_replace(below, "/?[^/]*$", "").alias("source_dir"), below.alias("example_path"),
    )


def study_summary(checked: DataFrame) -> DataFrame:
    """A row a study: its series by status, planes as they first occur among its series by id, slices, what was found wrong, and the series as JSON by id."""
    item = F.struct("series_id", "series_description", "plane", F.col("n_slices").alias("slice_count"), "rows", "columns", "pixel_spacing", "slice_spacing", "orientation", F.col("status").alias("validation_status"), F.col("messages").alias("validation_messages"), F.col("method").alias("ordering_method"))
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}_series")
    one = checked.groupBy("study_id").agg(F.count("*").alias("n_series"), n("VALID"), n("WARNING"), n("INVALID"), F.sum("n_slices").alias("n_slices"), F.array_sort(F.collect_list(item)).alias("s"))
    wrong = F.flatten(F.transform(F.filter("s", lambda x: x["validation_status"] != "VALID"), lambda x: F.transform(x["validation_messages"], lambda m: F.concat(x["series_id"], F.lit(": "), m))))
    return one.select("study_id", "n_series", "n_valid_series", "n_warning_series", "n_invalid_series", F.array_distinct("s.plane").alias("available_planes"), "n_slices", wrong.alias("validation_warnings"), F.to_json("s", {"ignoreNullFields": "false"}).alias("series"))


def scan_counts(checked: DataFrame) -> DataFrame:
    """Studies and series by status, in one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}_series")
    return checked.agg(F.count_distinct("study_id").alias("n_studies"), F.count("*").alias("n_series"), n("VALID"), n("WARNING"), n("INVALID"))


def scan_summary(headers: DataFrame) -> DataFrame:
    """Files by kind, with the studies and series that the readable ones make, in one row and one pass over the headers."""
    one = keyed(headers).groupBy("kind", *GROUP).agg(F.count("*").alias("n"))
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0).cast("long"))
    good = F.col("kind") == "dicom"
    return one.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("files_seen"), of("dicom").alias("dicom_valid"), of("unreadable").alias("dicom_unreadable"), of("not_dicom").alias("not_dicom"),
        F.count_distinct(F.when(good, F.col("study_id"))).alias("n_studies"), F.count_if(good).alias("n_series"),
    )


def write_manifests(checked: DataFrame, found_issues: DataFrame, dest: str, root: str = "") -> None:
    """Manifest as CSV and JSON, issues as CSV, study summaries as JSON; folders under ``dest`` are replaced."""
    # Ordering and validation of all slices run once; four sinks read their result.
    checked.write.mode("overwrite").parquet(f"{dest}/series")
    checked = checked.sparkSession.read.parquet(f"{dest}/series")
    rows = manifest(checked, root)
    rows.write.mode("overwrite").csv(f"{dest}/series_manifest_csv", header=True)
    rows.write.mode("overwrite").json(f"{dest}/series_manifest_json")
    found_issues.write.mode("overwrite").csv(f"{dest}/file_issues", header=True)
    study_summary(checked).write.mode("overwrite").json(f"{dest}/scan_summary")
