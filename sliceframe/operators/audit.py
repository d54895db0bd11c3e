"""Corpus audit: fourteen checks over files with header and pixel statistics, as findings with evidence and a sentence.

A file is a row: path, series_id, study_id, patient_id, ok (decoded), rows,
columns (of the pixels), max, std, digest (of raw pixels), slope, spacing_tag,
modality, syntax, photometric, description. What is counted by series, digest,
size, patient or value is aggregated there once. All hits of all checks then form
one table that is aggregated by check and key; evidence is the smallest few keys
of each check, which the tasks cut to that many before they are brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.operators.aggregates import describe

EVIDENCE = 5
#: Values that raise no finding (fixed values).
MODALITIES, SYNTAXES, PHOTOMETRIC = ("MR",), ("1.2.840.10008.1.2.1",), ("MONOCHROME2",)
#: Checks in order: code and severity where something hits, and those where nothing does; without the latter the check is silent then (fixed values).
CHECKS = {
    "unreadable_pixels": ("CRITICAL", "pixel_decode"), "duplicate_images": ("WARNING", None), "constant_or_empty_images": ("WARNING", None), "non_square_matrices": ("WARNING", "non_square_matrices"),
    "inconsistent_size_within_series": ("CRITICAL", "size_consistency"), "rescale_slope_inconsistent_within_series": ("WARNING", "rescale_consistency"), "spacing_tag_missing": ("WARNING", "spacing_tag_missing"),
    "slice_count_range": ("INFO", "slice_count_range"), "modality_check": ("WARNING", "modality_check"), "transfer_syntax_check": ("WARNING", "transfer_syntax_check"), "photometric_check": ("WARNING", "photometric_check"),
    "patient_id_reuse": ("WARNING", "patient_id_reuse"), "description_consistency": ("WARNING", "description_consistency"), "header_issues": ("CRITICAL", None),
}
#: Checks of the values of a column, and the values that are as they should be.
VALUES = {"modality_check": ("modality", MODALITIES), "transfer_syntax_check": ("syntax", SYNTAXES), "photometric_check": ("photometric", PHOTOMETRIC)}


def hits(rows: DataFrame, *checks: tuple[str, Column, Column, Column | None]) -> DataFrame:
    """(code, k, n): a row for each check (code, key, condition, weight or 1) that a row hits."""
    each = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(code).alias("code"), key.cast("string").alias("k"), (F.lit(1) if weight is None else weight).cast("long").alias("n"))) for code, key, hit, weight in checks]
    return rows.select(F.inline(F.array_compact(F.array(*each))))


def audit(files: DataFrame, issues: DataFrame | None = None, *, few: int = 20, many: int = 100) -> DataFrame:
    """(code, severity, n, evidence, detail) of all checks that say something. Empty tables give what checks say where nothing hits.

    ``issues`` (path) are files whose headers could not be read.
    """
    c = F.col
    ok = files.where("ok")
    several = lambda x: F.coalesce(F.min(x) != F.max(x), F.lit(False))
    digests = ok.groupBy("digest").agg(F.count("*").alias("m"), F.min("path").alias("path"))
    shapes = ok.groupBy("rows", "columns").agg(F.count("*").alias("m"))
    slope = F.round("slope", 6)
    series = files.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count("slope").alias("n_slope"), several(slope).alias("several_slopes"),
        (several(F.when(c("ok"), c("rows"))) | several(F.when(c("ok"), c("columns")))).alias("mixed_size"), several(c("description")).alias("mixed_description"), F.count("description").alias("n_description"),
    ).withColumn("partial_slopes", (c("n_slope") > 0) & (c("n_slope") < c("n")))
    patients = files.where("patient_id is not null").select("patient_id", "study_id").distinct().groupBy("patient_id").agg(F.count("*").alias("m"))
    values = files.select(F.inline(F.array(*[F.struct(F.lit(code).alias("code"), c(name).cast("string").alias("k")) for code, (name, _) in VALUES.items()]))).where("k is not null").distinct()
    known = reduce(lambda a, b: a | b, [(c("code") == code) & c("k").isin(*good) for code, (_, good) in VALUES.items()])
    found = [
        hits(files, ("unreadable_pixels", c("path"), ~c("ok"), None), ("constant_or_empty_images", c("path"), c("ok") & ((c("std") == 0) | (c("max") == 0)), None), ("spacing_tag_missing", c("series_id"), c("spacing_tag").isNull(), None)),
        hits(digests, ("duplicate_images", c("path"), c("m") > 1, c("m"))),
        hits(shapes, ("non_square_matrices", F.concat_ws("x", "rows", "columns"), c("rows") != c("columns"), c("m"))),
        hits(series, ("inconsistent_size_within_series", c("series_id"), c("mixed_size"), None), ("rescale_slope_inconsistent_within_series", c("series_id"), c("several_slopes") | c("partial_slopes"), None), ("description_consistency", c("series_id"), c("mixed_description"), None)),
        hits(patients, ("patient_id_reuse", c("patient_id"), c("m") > 1, None)),
        values.where(~known).select("code", "k", F.lit(1).cast("long").alias("n")),
    ]
    if issues is not None:
        found.append(hits(issues, ("header_issues", c("path"), F.lit(True), None)))
    by_key = reduce(DataFrame.unionByName, found).groupBy("code", "k").agg(F.sum("n").alias("n"))
    counts = by_key.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("n_keys"))
    first = by_key.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("k"))).where(c("r") <= EVIDENCE).groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("evidence"))

    # What sentences need beside the hits: a row of each grain.
    one = [
        files.agg(F.count("*").alias("files")),
        series.agg(F.count("*").alias("series"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(c("n") < few).alias("below"), F.count_if(c("n") > many).alias("above"), F.count_if("several_slopes").alias("slopes"), F.count_if("partial_slopes").alias("partial"), F.coalesce(F.max("n_description"), F.lit(0)).alias("described")),
        patients.agg(F.count("*").alias("patients")),
        # Distinct values of three coded columns, not of the files.
        values.agg(*[F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(c("code") == code, c("k")))), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]")).alias(code) for code in VALUES]),
    ]
    totals = reduce(lambda a, b: a.join(b, F.lit(True)), one)
    spark = files.sparkSession
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(other).cast("string").alias("other")) for i, (code, (severity, other)) in enumerate(CHECKS.items())])))
    d = F.broadcast(listed).join(F.broadcast(counts), "code", "left").join(F.broadcast(first), "code", "left").join(F.broadcast(totals), F.lit(True))
    d = d.withColumns({"n": F.coalesce("n", F.lit(0)), "n_keys": F.coalesce("n_keys", F.lit(0)), "evidence": F.coalesce("evidence", F.lit(""))})
    ranges = c("code") == "slice_count_range"
    any_ = c("n") > 0
    # Where nothing is described, nothing is consistent either.
    worst = F.when(any_ | ((c("code") == "description_consistency") & (c("described") == 0)), c("severity")).otherwise("INFO")
    said = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in sentences().items()]))
    return d.where(any_ | c("other").isNotNull()).select(
        F.when(any_, c("code")).otherwise(c("other")).alias("code"), worst.alias("severity"), F.when(ranges, c("series")).otherwise(c("n")).alias("n"),
        F.when(ranges, F.concat_ws(",", "least", "most", "below", "above")).otherwise(c("evidence")).alias("evidence"), F.element_at(said, c("code")).alias("detail"))


def sentences() -> dict[str, Column]:
    """What a finding says, by its check (wording is that of the reports it appears in: fixed values)."""
    say = lambda form, *args: F.format_string(form, *[F.col(a) for a in args])
    either = lambda hit, clean: F.when(F.col("n") > 0, hit).otherwise(clean)
    return {
        "unreadable_pixels": either(say("%d file(s) failed pixel decode", "n"), say("all %d files decoded successfully", "files")),
        "duplicate_images": say("%d files share exact pixel content in %d group(s)", "n", "n_keys"),
        "constant_or_empty_images": say("%d image(s) are constant or all-zero", "n"),
        "non_square_matrices": say("%d image(s) have Rows != Columns", "n"),
        "inconsistent_size_within_series": either(say("%d series mix matrix sizes", "n"), F.lit("matrix size constant within every series")),
        "rescale_slope_inconsistent_within_series": either(say("%d series with multiple slopes, %d with slope on some slices only", "slopes", "partial"), F.lit("RescaleSlope constant-or-absent within each series")),
        "spacing_tag_missing": say("SpacingBetweenSlices absent on %d/%d files (geometry still recoverable from IPP)", "n", "files"),
        "slice_count_range": F.when(F.col("series") > 0, say("slices per series: min=%d max=%d", "least", "most")).otherwise("no series"),
        "modality_check": say("modalities present: %s", "modality_check"),
        "transfer_syntax_check": say("transfer syntaxes present: %s", "transfer_syntax_check"),
        "photometric_check": say("photometric interpretations: %s", "photometric_check"),
        "patient_id_reuse": say("%d distinct pseudonymized PatientIDs in subset; %d map to >1 study", "patients", "n"),
        "description_consistency": F.when(F.col("n") > 0, "some series mix descriptions").when(F.col("described") == 0, "no series is described").otherwise("SeriesDescription constant within every series"),
        "header_issues": say("%d header-level issue(s)", "n"),
    }


def scope(files: DataFrame) -> DataFrame:
    """What was audited, in one row: files, decode failures, series, studies."""
    return files.agg(F.count("*").alias("n_files"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("n_decode_failures"), F.count_distinct("series_id").alias("n_series"), F.count_distinct("study_id").alias("n_studies"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n) of all three severities."""
    n = lambda s: F.struct(F.lit(s).alias("severity"), F.count_if(F.col("severity") == s).alias("n"))
    return findings.agg(F.array(n("CRITICAL"), n("WARNING"), n("INFO")).alias("s")).select(F.inline("s"))


def intensity(files: DataFrame) -> DataFrame:
    """One row over decoded files (min, max): the global range, and how the files' maxima are distributed."""
    ok = files.where("ok")
    whole = ok.agg(F.min("min").cast("double").alias("global_min"), F.max("max").cast("double").alias("global_max"))
    return whole.join(describe(ok.select("max"), "max"), F.lit(True))
