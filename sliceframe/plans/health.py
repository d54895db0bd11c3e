"""Queries over headers, series and studies: audit, validation, stage 2 and reports, each with its oracle.

The driver's line items stand for files, orders for series: header fields are
fixed functions of their keys, written once for both engines, and chosen so that
every rule is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.operators import audit
from sliceframe.plans import collection, preparation
from sliceframe.plans.catalog import query

#: Fields of a file by order and line number, in expressions that both engines read.
FILE = {
    "path": "concat(l_orderkey, '/', l_linenumber, '-', l_partkey, '-', l_suppkey)", "series_id": "concat('S', l_orderkey)", "study_id": "concat('T', l_orderkey % 500)", "instance": "CAST(CASE WHEN l_orderkey % 62 <> 0 OR l_linenumber <> 2 THEN l_linenumber END AS INT)",
    "rows": "CAST(CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 2 THEN 256 WHEN l_orderkey % 23 = 0 AND l_linenumber = 1 THEN NULL ELSE 512 END AS INT)",
    "columns": "CAST(CASE WHEN l_orderkey % 11 = 0 THEN 384 ELSE 512 END AS INT)",
    "modality": "CASE WHEN l_orderkey % 29 = 0 THEN 'CT' ELSE 'MR' END", "syntax": "CASE WHEN l_orderkey % 43 = 0 AND l_linenumber > 2 THEN '1.2.840.10008.1.2' ELSE '1.2.840.10008.1.2.1' END",
    "photometric": "CASE WHEN l_orderkey % 47 = 0 THEN 'MONOCHROME1' ELSE 'MONOCHROME2' END",
    "description": "CASE WHEN l_orderkey % 53 = 0 THEN concat('AX T', l_linenumber) WHEN l_orderkey % 5 = 0 THEN 'SAG PD' ELSE 'T2' END",
    "slope": "CAST(CASE WHEN l_orderkey % 13 = 0 THEN 1 + l_linenumber WHEN l_orderkey % 7 = 0 AND l_linenumber > 1 THEN NULL ELSE 1 END AS DOUBLE)",
    "spacing_tag": "CAST(CASE WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_orderkey % 10 = 0 THEN 9 ELSE 4 END AS DOUBLE)",
    "spacing": "CAST(CASE WHEN l_orderkey % 59 = 0 AND l_linenumber = 1 THEN NULL WHEN l_orderkey % 61 = 0 THEN l_linenumber ELSE 1 END AS DOUBLE)",
    "frames": "CAST(CASE WHEN l_orderkey % 67 = 0 THEN 3 ELSE 1 END AS INT)", "flip": "l_orderkey % 73 = 0 AND l_linenumber = 2",
    "axis": "CAST(CASE WHEN l_orderkey % 79 = 0 AND l_linenumber = 1 THEN NULL WHEN l_orderkey % 37 = 0 AND l_linenumber = 2 THEN (l_orderkey + 1) % 3 ELSE l_orderkey % 3 END AS INT)",
    "z": "CAST(CASE WHEN l_orderkey % 31 = 0 AND l_linenumber = 1 THEN NULL WHEN l_orderkey % 19 = 0 AND l_linenumber = 3 THEN 8 WHEN l_orderkey % 9 = 0 AND l_linenumber = 2 THEN 6.5 ELSE l_linenumber * 4 END AS DOUBLE)",
    "patient_id": "CASE WHEN l_orderkey % 71 = 0 THEN NULL WHEN l_orderkey % 500 < 20 THEN 'P0' ELSE concat('P', l_orderkey % 500) END",
    "ok": "l_partkey % 97 <> 0", "digest": "concat(l_partkey, '-', l_suppkey)", "std": "CASE WHEN l_quantity = 1 THEN 0e0 ELSE 1e0 END", "max": "CASE WHEN l_quantity = 2 THEN 0e0 ELSE 9e0 END",
}
ATTRIBUTES = {
    "series_id": "concat('S', o_orderkey)", "study_id": "concat('T', CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey % 500 END)",
    "plane_csv": "CASE CAST(floor(o_orderkey / 500) AS BIGINT) % 4 WHEN 0 THEN 'Axial' WHEN 1 THEN 'Coronal' WHEN 2 THEN 'Sagittal' END", "fluid": "CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS INT)",
}
#: Row and column directions by axis: axial, coronal, sagittal.
SIGN = "CASE WHEN flip THEN -1e0 ELSE 1e0 END"
IOP = f"CASE axis WHEN 0 THEN array({SIGN}, 0e0, 0e0, 0e0, 1e0, 0e0) WHEN 1 THEN array({SIGN}, 0e0, 0e0, 0e0, 0e0, 1e0) WHEN 2 THEN array(0e0, {SIGN}, 0e0, 0e0, 0e0, 1e0) END"
IPP = "CASE WHEN z IS NOT NULL THEN CASE CAST(substring(series_id, 2) AS BIGINT) % 3 WHEN 0 THEN array(0e0, 0e0, z) WHEN 1 THEN array(0e0, z, 0e0) ELSE array(z, 0e0, 0e0) END END"

columns = lambda fields: ", ".join(f"{e} AS {n}" for n, e in fields.items())
H = f"h AS (SELECT l_orderkey AS k, {columns(FILE)} FROM lineitem), a AS (SELECT o_orderkey AS k, {columns(ATTRIBUTES)} FROM orders)"


def files(t) -> DataFrame:
    return t("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in FILE.items()])


def attributes(t) -> DataFrame:
    return t("orders").selectExpr(*[f"{e} AS {n}" for n, e in ATTRIBUTES.items()])


def headers(t) -> DataFrame:
    return files(t).selectExpr("*", f"{IOP} AS iop", f"{IPP} AS ipp", "path AS sop_uid")


def dicom(t) -> DataFrame:
    """The same headers as the DICOM source names them."""
    h = headers(t).selectExpr(
        "'dicom' AS kind", "path", "study_id AS StudyInstanceUID", "series_id AS SeriesInstanceUID", "sop_uid AS SOPInstanceUID", "iop AS ImageOrientationPatient", "ipp AS ImagePositionPatient",
        "CASE WHEN spacing IS NOT NULL THEN array(spacing, spacing) END AS PixelSpacing", "instance AS InstanceNumber", "rows AS Rows", "columns AS Columns", "frames AS NumberOfFrames", "syntax AS TransferSyntaxUID",
        "description AS SeriesDescription", "1 AS SeriesNumber", "modality AS Modality", "CAST(NULL AS STRING) AS BodyPartExamined", "CAST(NULL AS STRING) AS ProtocolName", "CAST(NULL AS STRING) AS SequenceName", "CAST(NULL AS DOUBLE) AS SliceThickness", "spacing_tag AS SpacingBetweenSlices")
    return h


def found(code: str, severity: str, rows: str, hit: str, key: str, other: str | None = "INFO", else_code: str | None = None, weight: str = "1") -> str:
    pick = f"SELECT CASE WHEN n > 0 THEN '{code}' ELSE '{else_code or code}' END AS code, CASE WHEN n > 0 THEN '{severity}' ELSE '{other or 'INFO'}' END AS severity, n, evidence FROM "
    inner = f"(SELECT CAST(coalesce(sum({weight}), 0) AS BIGINT) AS n FROM {rows} WHERE {hit}), (SELECT coalesce(string_agg(e, ',' ORDER BY e), '') AS evidence FROM (SELECT DISTINCT CAST({key} AS VARCHAR) AS e FROM {rows} WHERE {hit} ORDER BY 1 LIMIT 5))"
    return pick + inner + ("" if other else " WHERE n > 0")


AUDIT_TABLES = f"""WITH {H}, ok AS (SELECT * FROM h WHERE ok),
dg AS (SELECT digest, count(*) AS m, min(path) AS path FROM ok GROUP BY 1), sh AS (SELECT rows, columns, count(*) AS m FROM ok GROUP BY 1, 2),
sr AS (SELECT series_id, count(*) AS n, count(slope) AS n_slope, count(DISTINCT round(slope, 6)) AS slopes, count(DISTINCT rows) FILTER (WHERE ok) AS r, count(DISTINCT columns) FILTER (WHERE ok) AS c, count(DISTINCT description) AS d FROM h GROUP BY 1),
pt AS (SELECT patient_id, count(DISTINCT study_id) AS m FROM h WHERE patient_id IS NOT NULL GROUP BY 1)
"""
AUDIT_FINDINGS = " UNION ALL ".join([
    found("unreadable_pixels", "CRITICAL", "h", "NOT ok", "path", else_code="pixel_decode"),
    found("duplicate_images", "WARNING", "dg", "m > 1", "path", None, weight="m"),
    found("constant_or_empty_images", "WARNING", "ok", "std = 0 OR max = 0", "path", None),
    found("non_square_matrices", "WARNING", "sh", "rows <> columns", "concat(rows, 'x', columns)", weight="m"),
    found("inconsistent_size_within_series", "CRITICAL", "sr", "r > 1 OR c > 1", "series_id", else_code="size_consistency"),
    found("rescale_slope_inconsistent_within_series", "WARNING", "sr", "slopes > 1 OR (n_slope > 0 AND n_slope < n)", "series_id", else_code="rescale_consistency"),
    found("spacing_tag_missing", "WARNING", "h", "spacing_tag IS NULL", "series_id"),
    "SELECT 'slice_count_range', 'INFO', count(*), concat(min(n), ',', max(n), ',', count(CASE WHEN n < 20 THEN 1 END), ',', count(CASE WHEN n > 100 THEN 1 END)) FROM sr",
    found("modality_check", "WARNING", "(SELECT DISTINCT modality FROM h)", "modality NOT IN ('MR')", "modality"),
    found("transfer_syntax_check", "WARNING", "(SELECT DISTINCT syntax FROM h)", "syntax NOT IN ('1.2.840.10008.1.2.1')", "syntax"),
    found("photometric_check", "WARNING", "(SELECT DISTINCT photometric FROM h)", "photometric NOT IN ('MONOCHROME2')", "photometric"),
    found("patient_id_reuse", "WARNING", "pt", "m > 1", "patient_id"),
    found("description_consistency", "WARNING", "sr", "d > 1", "series_id"),
    found("header_issues", "CRITICAL", "(SELECT path FROM h WHERE rows IS NULL)", "true", "path", None),
])
AUDIT = AUDIT_TABLES + AUDIT_FINDINGS


def audited(t) -> DataFrame:
    f = files(t)
    return audit.audit(f, f.where("rows is null").select("path"))


@query(AUDIT)
def corpus_audit(t):
    """All checks of the audit, with evidence."""
    return audited(t).drop("detail")


PRESENT = lambda c: f"(SELECT concat('[', string_agg(concat(chr(39), v, chr(39)), ', ' ORDER BY v), ']') FROM (SELECT DISTINCT {c} AS v FROM h WHERE {c} IS NOT NULL))"
#: By code what it says; codes that the driver's tables never raise are left to the tests.
DETAILS = {
    "unreadable_pixels": "concat((SELECT count(*) FROM h WHERE NOT ok), ' file(s) failed pixel decode')", "duplicate_images": "(SELECT concat(sum(m), ' files share exact pixel content in ', count(*), ' group(s)') FROM dg WHERE m > 1)",
    "constant_or_empty_images": "concat((SELECT count(*) FROM ok WHERE std = 0 OR max = 0), ' image(s) are constant or all-zero')", "non_square_matrices": "concat((SELECT sum(m) FROM sh WHERE rows <> columns), ' image(s) have Rows != Columns')",
    "inconsistent_size_within_series": "concat((SELECT count(*) FROM sr WHERE r > 1 OR c > 1), ' series mix matrix sizes')", "rescale_slope_inconsistent_within_series": "(SELECT concat(count(CASE WHEN slopes > 1 THEN 1 END), ' series with multiple slopes, ', count(CASE WHEN n_slope > 0 AND n_slope < n THEN 1 END), ' with slope on some slices only') FROM sr)",
    "spacing_tag_missing": "(SELECT concat('SpacingBetweenSlices absent on ', count(*) - count(spacing_tag), '/', count(*), ' files (geometry still recoverable from IPP)') FROM h)", "slice_count_range": "(SELECT concat('slices per series: min=', min(n), ' max=', max(n)) FROM sr)",
    "modality_check": f"concat('modalities present: ', {PRESENT('modality')})", "transfer_syntax_check": f"concat('transfer syntaxes present: ', {PRESENT('syntax')})", "photometric_check": f"concat('photometric interpretations: ', {PRESENT('photometric')})",
    "patient_id_reuse": "(SELECT concat(count(*), ' distinct pseudonymized PatientIDs in subset; ', count(CASE WHEN m > 1 THEN 1 END), ' map to >1 study') FROM pt)", "description_consistency": "'some series mix descriptions'", "header_issues": "concat((SELECT count(*) FROM h WHERE rows IS NULL), ' header-level issue(s)')",
}


@query(f"{AUDIT_TABLES} SELECT code, CASE code {' '.join(f'WHEN {c!r} THEN {e}' for c, e in DETAILS.items())} END AS detail FROM ({AUDIT_FINDINGS})")
def audit_details(t):
    """What each finding of the audit says."""
    return audited(t).select("code", "detail")


#: Prices stand for a file's highest pixel, quantities for its lowest.
INTENSITY = {"n": "count(v)", "mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "p1": "quantile_cont(v, 0.01)", "p25": "quantile_cont(v, 0.25)", "median": "median(v)", "p75": "quantile_cont(v, 0.75)", "p99": "quantile_cont(v, 0.99)", "max": "max(v)", "global_min": "min(lo)", "global_max": "max(v)"}


@query(f"""{AUDIT_TABLES}, f AS ({AUDIT_FINDINGS}), v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS lo FROM lineitem WHERE {FILE['ok']})
SELECT part, name, round(CAST(value AS DOUBLE), 4) AS value FROM (SELECT 'scope' AS part, 'n_files' AS name, count(*)::DOUBLE AS value FROM h UNION ALL SELECT 'scope', 'n_decode_failures', count(CASE WHEN NOT ok THEN 1 END) FROM h UNION ALL SELECT 'scope', 'n_series', count(DISTINCT series_id) FROM h UNION ALL SELECT 'scope', 'n_studies', count(DISTINCT study_id) FROM h
UNION ALL SELECT 'severity', s, count(severity) FROM (SELECT unnest(['CRITICAL', 'WARNING', 'INFO']) AS s) LEFT JOIN f ON s = severity GROUP BY s {' '.join(f"UNION ALL SELECT 'intensity', '{n}', {e} FROM v" for n, e in INTENSITY.items())})""")
def audit_report(t):
    """The audit's scope, findings by severity and intensities, in long form."""
    light = t("lineitem").selectExpr(f"{FILE['ok']} AS ok", "CAST(l_quantity AS DOUBLE) AS min", "CAST(l_extendedprice AS DOUBLE) AS max")
    # One row each.
    long = lambda part, d: d.select(F.lit(part).alias("part"), F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in d.columns])))
    severity = audit.severity_counts(audited(t)).select(F.lit("severity").alias("part"), F.col("severity").alias("name"), F.col("n").cast("double").alias("value"))
    return long("scope", audit.scope(files(t))).unionByName(severity).unionByName(long("intensity", audit.intensity(light))).withColumn("value", F.round("value", 4))


#: Geometry by series: a series is spatially ready if all have a position and normals agree, in stage 2 in their sign too.
GEO = f"""{H}, g0 AS (SELECT *, bool_and(z IS NOT NULL AND axis IS NOT NULL) OVER s AND min(axis) OVER s = max(axis) OVER s AS spatial, bool_and(z IS NOT NULL) OVER s AS sited, min(flip) OVER s = max(flip) OVER s AS steady, bool_and(instance IS NOT NULL) OVER s AS counted, first_value(axis) OVER (s ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS axis0 FROM h WINDOW s AS (PARTITION BY k)),
g AS (SELECT *, sited AND axis0 IS NOT NULL AS placed, spatial AND steady AS spatial2, CASE WHEN counted THEN 'instance_number' ELSE 'sop_instance_uid' END AS fallback FROM g0),
p AS (SELECT *, CASE WHEN axis0 = k % 3 THEN z WHEN axis0 IS NOT NULL THEN 0e0 END AS pos FROM g), q AS (SELECT *, abs(pos - lag(pos) OVER (PARTITION BY k ORDER BY CASE WHEN spatial THEN pos END, path)) AS gap FROM p)"""

STAGE1 = f"""WITH {GEO}, s AS (SELECT k, count(*) AS n, bool_and(spatial) AS spatial, min(fallback) AS fallback, bool_and(placed) AS placed, count(*) - count(axis) AS no_iop, count(*) - count(rows) AS no_size, greatest(count(DISTINCT rows), count(DISTINCT columns)) AS sizes, count(*) - count(spacing) AS no_sp, count(DISTINCT spacing) AS sps,
count(DISTINCT concat(axis, flip)) AS axes, count(*) - count(z) AS no_ipp, count(CASE WHEN gap < 1e-3 THEN 1 END) AS dup, median(gap) AS med, stddev_pop(gap) / nullif(avg(gap), 0) AS cv, min(axis) AS axis, min(spacing_tag) AS tag, max(frames) AS frames, count(DISTINCT syntax) AS syn, arg_min(description, path) AS descr FROM q GROUP BY k),
x AS (SELECT *, CASE WHEN spatial THEN CASE axis WHEN 0 THEN 'axial' WHEN 1 THEN 'coronal' ELSE 'sagittal' END ELSE 'unknown' END AS plane, CASE WHEN descr LIKE 'AX%' THEN 'axial' WHEN descr LIKE 'SAG%' THEN 'sagittal' END AS hint FROM s),
c AS (SELECT *, list_filter([CASE WHEN no_size > 0 THEN 'missing_size' END, CASE WHEN sizes > 1 THEN 'mixed_size' END, CASE WHEN no_sp > 0 THEN 'missing_spacing' END, CASE WHEN no_sp = 0 AND sps > 1 THEN 'mixed_spacing' END, CASE WHEN no_iop > 0 THEN 'missing_orientation' END, CASE WHEN no_iop = 0 AND axes > 1 THEN 'mixed_orientation' END,
CASE WHEN no_ipp > 0 THEN 'missing_position' END, CASE WHEN NOT spatial THEN 'ordering_fallback' END, CASE WHEN placed AND dup > 0 THEN 'duplicate_positions' END, CASE WHEN placed AND cv > 0.15 THEN 'irregular_gaps' END, CASE WHEN placed AND abs(med - tag) / tag > 0.25 THEN 'spacing_disagrees' END,
CASE WHEN NOT placed THEN 'positions_unknown' END, CASE WHEN n < 4 THEN 'few_slices' END, CASE WHEN plane = 'unknown' THEN 'plane_unknown' END, CASE WHEN frames > 1 THEN 'multi_frame' END, CASE WHEN syn > 1 THEN 'mixed_transfer_syntax' END, CASE WHEN plane <> 'unknown' AND hint <> plane THEN 'description_disagrees' END], lambda v: v IS NOT NULL) AS codes FROM x)"""


@query(f"{STAGE1} SELECT concat('S', k) AS series_id, n AS n_slices, CASE WHEN spatial THEN 'spatial' ELSE fallback END AS method, plane, CASE WHEN len(list_filter(codes, lambda v: v IN ('mixed_size', 'mixed_orientation'))) > 0 THEN 'INVALID' WHEN len(codes) > 0 THEN 'WARNING' ELSE 'VALID' END AS status, array_to_string(codes, ' | ') AS codes, round(CASE WHEN placed AND med IS NOT NULL THEN med ELSE tag END, 6) AS slice_spacing FROM c")
def stage1_validation(t):
    """Headers to ordered slices to validated series, by the library's own rules."""
    done = collection.validated(collection.series_table(collection.slice_table(dicom(t))))
    return done.select("series_id", "n_slices", "method", "plane", "status", F.array_join("codes", " | ").alias("codes"), F.round("slice_spacing", 6).alias("slice_spacing"))


SAYS = f"""{STAGE1}, say AS (SELECT *, concat('T', k % 500) AS study_id, concat('S', k) AS series_id, CASE WHEN len(list_filter(codes, lambda v: v IN ('mixed_size', 'mixed_orientation'))) > 0 THEN 'INVALID' WHEN len(codes) > 0 THEN 'WARNING' ELSE 'VALID' END AS status,
CASE WHEN len(codes) = 0 THEN ['all inspected checks passed'] ELSE list_transform(codes, lambda v: CASE v WHEN 'few_slices' THEN concat('few slices (', n, ' < 4)') WHEN 'plane_unknown' THEN 'anatomical plane unknown' WHEN 'ordering_fallback' THEN concat('slice order used fallback method=', fallback) WHEN 'positions_unknown' THEN 'could not compute slice positions for spacing checks' WHEN 'irregular_gaps' THEN printf('unusual slice spacing variation CV=%.3f > 0.15', cv)
WHEN 'missing_size' THEN 'missing Rows/Columns on at least one instance' WHEN 'duplicate_positions' THEN 'duplicate or near-duplicate slice positions' WHEN 'missing_orientation' THEN 'missing ImageOrientationPatient on at least one instance' WHEN 'mixed_orientation' THEN 'inconsistent ImageOrientationPatient across slices' WHEN 'missing_position' THEN 'missing ImagePositionPatient on at least one instance' WHEN 'missing_spacing' THEN 'missing PixelSpacing on at least one instance'
WHEN 'description_disagrees' THEN 'SeriesDescription plane hint disagrees with spatial plane' ELSE v END) END AS messages FROM c)"""
#: Codes whose sentences the oracle does not repeat.
UNSAID = ["mixed_size", "mixed_spacing", "spacing_disagrees", "multi_frame", "mixed_transfer_syntax"]


def validated_series(t) -> DataFrame:
    return collection.validated(collection.series_table(collection.slice_table(dicom(t))))


@query(f"{SAYS} SELECT study_id, count(*) AS n_series, count(CASE WHEN status = 'VALID' THEN 1 END) AS n_valid_series, count(CASE WHEN status = 'WARNING' THEN 1 END) AS n_warning_series, count(CASE WHEN status = 'INVALID' THEN 1 END) AS n_invalid_series, CAST(sum(n) AS BIGINT) AS n_slices, array_to_string(list_sort(list(DISTINCT plane)), ' ') AS planes, CAST(sum(CASE WHEN status <> 'VALID' THEN len(codes) ELSE 0 END) AS BIGINT) AS n_warnings FROM say GROUP BY study_id")
def study_summaries(t):
    """The library's study summary."""
    d = collection.study_summary(validated_series(t))
    return d.select("study_id", "n_series", "n_valid_series", "n_warning_series", "n_invalid_series", "n_slices", F.array_join(F.array_sort("available_planes"), " ").alias("planes"), F.size("validation_warnings").cast("long").alias("n_warnings"))


@query(f"{SAYS} SELECT count(DISTINCT study_id) AS n_studies, count(*) AS n_series, count(CASE WHEN status = 'VALID' THEN 1 END) AS n_valid_series, count(CASE WHEN status = 'WARNING' THEN 1 END) AS n_warning_series, count(CASE WHEN status = 'INVALID' THEN 1 END) AS n_invalid_series FROM say")
def scan_statistics(t):
    """The library's scan statistics."""
    return collection.scan_counts(validated_series(t))


@query(f"{SAYS} SELECT series_id, status, array_to_string(list_transform(list_zip(codes, messages), lambda x: CASE WHEN x[1] IN ({', '.join(repr(u) for u in UNSAID)}) THEN x[1] ELSE x[2] END), ' | ') AS messages FROM say WHERE len(codes) > 0 UNION ALL SELECT series_id, status, messages[1] FROM say WHERE len(codes) = 0")
def series_messages(t):
    """The sentences of series by the library's rules; those that list a series' values are told by their code here, and tested on small tables."""
    d = validated_series(t)
    said = F.zip_with("codes", "messages", lambda c, m: F.when(c.isin(*UNSAID), c).otherwise(m))
    return d.select("series_id", "status", F.array_join(F.when(F.size("codes") == 0, F.col("messages")).otherwise(said), " | ").alias("messages"))


INFO = f"""{GEO}, s AS (SELECT k, concat('S', k) AS series_id, min(h.study_id) AS study_id, count(*) AS n, bool_and(spatial2) AS spatial, min(fallback) AS fallback, count(*) - count(rows) AS no_size, count(DISTINCT CASE WHEN rows IS NOT NULL THEN rows * 10000 + columns END) AS sizes, min(modality) AS modality, min(axis) AS axis,
count(CASE WHEN spatial2 AND gap < 1e-3 THEN 1 END) AS dup, CASE WHEN bool_and(spatial2) THEN median(gap) END AS med, CASE WHEN bool_and(spatial2) THEN stddev_pop(gap) / nullif(avg(gap), 0) END AS cv,
list(rows ORDER BY CASE WHEN spatial2 AND axis = 1 THEN -pos WHEN spatial2 THEN pos END, path)[1] AS rows, min(columns) AS columns FROM q h GROUP BY k),
i AS (SELECT s.*, a.plane_csv, a.fluid, CASE WHEN spatial THEN CASE s.axis WHEN 0 THEN 'axial' WHEN 1 THEN 'coronal' ELSE 'sagittal' END ELSE 'unknown' END AS plane, (CASE WHEN rows IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN spatial THEN 1 ELSE 0 END) / 6e0 AS completeness FROM s LEFT JOIN a ON s.series_id = a.series_id)"""


def info(t) -> DataFrame:
    return preparation.series_info(headers(t), attributes(t))


@query(f"WITH {INFO} SELECT study_id, series_id, n AS n_slices, CASE WHEN spatial THEN 'spatial' ELSE fallback END AS method, plane, plane_csv, fluid, rows, columns, modality, dup AS n_dup, round(med, 6) AS median_gap, round(cv, 6) AS gap_cv, round(completeness, 6) AS completeness FROM i")
def series_infos(t):
    return info(t).select("study_id", "series_id", "n_slices", "method", "plane", "plane_csv", "fluid", "rows", "columns", "modality", "n_dup", *[F.round(c, 6).alias(c) for c in ("median_gap", "gap_cv", "completeness")])


COMPONENTS = f"""{INFO}, m AS (SELECT *, CASE WHEN plane <> 'unknown' THEN lower(plane_csv) = plane END AS agree FROM i),
k AS (SELECT *, round(greatest(n - 3, 0) / 45e0 / (1 + greatest(n - 3, 0) / 45e0), 6) AS c1, round(coalesce(rows, 0)::DOUBLE * columns / 262144 / (1 + coalesce(rows, 0)::DOUBLE * columns / 262144), 6) AS c2, round(completeness, 6) AS c3,
CASE WHEN spatial THEN 1 - CASE WHEN cv > 0.15 THEN 0.5 ELSE 0 END - CASE WHEN dup > 0 THEN 0.25 ELSE 0 END - CASE WHEN agree = false THEN 0.25 ELSE 0 END ELSE 0.5 END::DOUBLE AS c4, CASE WHEN fluid IS NOT NULL AND plane_csv <> 'Axial' THEN CASE WHEN fluid = 1 THEN 1 ELSE 0 END END AS f FROM m),
r AS (SELECT *, plane_csv AS slot, round(coalesce(f, 0) * 1.5::DOUBLE + c1 + c2 * 0.5::DOUBLE + c3 + c4 * 2, 6) AS score FROM k WHERE plane_csv IS NOT NULL),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY study_id, slot ORDER BY score DESC, n DESC, series_id) AS INTEGER) AS rnk FROM r)"""


@query(f"""WITH {COMPONENTS} SELECT study_id, slot, series_id, c1 AS c_slices, c2 AS c_resolution, c3 AS c_completeness, c4 AS c_consistency, score, rnk,
concat(CASE WHEN f IS NOT NULL THEN concat('fluid_sensitive=', fluid, CASE WHEN f = 1 THEN ' == ' ELSE ' != ' END, 'preference 1; ') ELSE '' END, printf('slices=%.3f x w=1; resolution=%.3f x w=0.5; completeness=%.3f x w=1; consistency=%.3f x w=2', c1, c2, c3, c4)) AS reasons FROM rr""")
def candidate_report(t):
    """Candidates by slot with components, rank and reasons."""
    d = preparation.candidates(info(t), settings.defaults())
    return d.select("study_id", "slot", "series_id", "c_slices", "c_resolution", "c_completeness", "c_consistency", "score", "rnk", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""WITH {COMPONENTS}, e AS (SELECT DISTINCT study_id, unnest(['Axial', 'Coronal', 'Sagittal']) AS slot FROM i), n AS (SELECT study_id, slot, count(*) AS n FROM rr GROUP BY 1, 2)
SELECT e.study_id, e.slot, CASE WHEN e.slot <> 'Axial' THEN 1 END AS fluid_preference, rr.series_id, rr.score, coalesce(n.n, 0) AS n_candidates, CASE WHEN rr.series_id IS NULL THEN concat('no candidate series matches plane ', e.slot) ELSE '' END AS note FROM e LEFT JOIN rr ON e.study_id = rr.study_id AND e.slot = rr.slot AND rnk = 1 LEFT JOIN n ON e.study_id = n.study_id AND e.slot = n.slot""")
def selection_report(t):
    return preparation.selection_report(info(t), settings.defaults())


@query(f"""WITH {INFO}, c AS (SELECT *, list_filter([CASE WHEN modality <> 'MR' THEN 'unexpected_modality' END, CASE WHEN n < 3 THEN 'insufficient_slices' END, CASE WHEN NOT spatial THEN 'missing_geometry' END, CASE WHEN spatial AND dup > 0 THEN 'duplicate_positions' END, CASE WHEN spatial AND cv > 0.15 THEN 'inconsistent_spacing' END,
CASE WHEN no_size > 0 THEN 'inconsistent_dimensions' END, CASE WHEN sizes > 1 THEN 'inconsistent_dimensions' END, CASE WHEN plane <> 'unknown' AND lower(plane_csv) <> plane THEN 'plane_mismatch' END, CASE WHEN plane = 'unknown' THEN 'unusual_orientation' END], lambda v: v IS NOT NULL) AS codes FROM i)
SELECT series_id, array_to_string(codes, ' | ') AS codes, n >= 3 AND sizes <= 1 AS usable FROM c""")
def stage2_checks(t):
    """Quality checks of series by the library's own rules."""
    return preparation.checked(info(t), settings.defaults()).select("series_id", F.array_join("codes", " | ").alias("codes"), "usable")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem), s AS (SELECT concat(l_orderkey, '/', l_linenumber) AS path, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, count(CASE WHEN l_discount < 0.1 THEN 1 END) AS fin FROM h GROUP BY 1)
SELECT path, CASE WHEN fin < n THEN 'BLOCKING' ELSE 'WARNING' END AS severity, CASE WHEN fin < n THEN 'invalid_pixels' ELSE 'constant_pixels' END AS code FROM s WHERE fin < n OR lo = hi""")
def pixel_checks(t):
    s = t("lineitem").groupBy(F.expr("concat(l_orderkey, '/', l_linenumber)").alias("path")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"), F.count_if(F.col("l_discount") < 0.1).alias("n_finite"))
    return preparation.pixel_issues(s)


@query(f"""WITH {INFO}, u AS (SELECT a.study_id AS s1, i.* FROM i JOIN a ON i.series_id = a.series_id)
SELECT (SELECT count(DISTINCT study_id) FROM a) AS listed_studies, (SELECT count(*) FROM a) AS listed_series, (SELECT count(DISTINCT study_id) FROM i) AS found_studies, (SELECT count(*) FROM i) AS found_series,
(SELECT count(*) FROM a ANTI JOIN i USING (series_id)) AS listed_only, (SELECT count(*) FROM i ANTI JOIN a ON i.series_id = a.series_id) AS found_only, (SELECT bool_and(s1 = study_id) FROM u) AS mapping_consistent, (SELECT count(*) FROM u WHERE s1 <> study_id) AS moved,
(SELECT min(n) FROM i) AS min_slices, (SELECT max(n) FROM i) AS max_slices, (SELECT round(avg(n), 6) FROM i) AS mean_slices, (SELECT count(*) FROM i WHERE rows <> columns) AS non_square""")
def structure_report(t):
    """Coverage and structure: listed against found studies and series, their mapping, slices a series."""
    i = info(t).select("series_id", F.col("study_id").alias("found_study"), "n_slices", "rows", "columns")
    both = i.join(attributes(t).select("series_id", F.col("study_id").alias("listed_study"), F.lit(True).alias("listed")), "series_id", "full")
    c, there, listed = F.col, F.col("n_slices").isNotNull(), F.col("listed").isNotNull()
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    # Studies are counted by group first: one row a study and side.
    one = both.agg(
        n(listed).alias("listed_series"), n(there).alias("found_series"), n(listed & ~there).alias("listed_only"), n(there & ~listed).alias("found_only"),
        F.bool_and(c("listed_study") == c("found_study")).alias("mapping_consistent"), n(c("listed_study") != c("found_study")).alias("moved"), F.min("n_slices").alias("min_slices"), F.max("n_slices").alias("max_slices"),
        F.round(F.avg("n_slices"), 6).alias("mean_slices"), n(c("rows") != c("columns")).alias("non_square"))
    studies = both.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), c("listed_study").alias("s")), F.struct(F.lit(2).alias("side"), c("found_study").alias("s")))).alias("x")).where("x.s is not null").distinct()
    counted = studies.agg(F.count_if(c("x.side") == 1).alias("listed_studies"), F.count_if(c("x.side") == 2).alias("found_studies"))
    return one.join(counted, F.lit(True))


@query(f"""WITH {INFO} SELECT plane_csv, count(*) AS n, count(CASE WHEN lower(plane_csv) = plane THEN 1 END) AS n_agree, round(count(CASE WHEN lower(plane_csv) = plane THEN 1 END) / count(*)::DOUBLE, 6) AS rate
FROM i WHERE plane_csv IS NOT NULL AND plane <> 'unknown' GROUP BY 1""")
def orientation_report(t):
    """Agreement of listed and derived planes where both are known."""
    d = info(t).where("plane_csv is not null and plane != 'unknown'").withColumn("same", preparation.agrees())
    return d.groupBy("plane_csv").agg(F.count("*").alias("n"), F.count_if("same").alias("n_agree"), F.round(F.count_if("same") / F.count("*"), 6).alias("rate"))


@query(f"""WITH {INFO} SELECT count(*) AS n_series, count(CASE WHEN spatial THEN 1 END) AS n_spatial, round(max(cv), 6) AS max_gap_cv, count(CASE WHEN dup > 0 THEN 1 END) AS n_with_duplicates, round(min(med), 6) AS min_gap, round(max(med), 6) AS max_gap FROM i""")
def ordering_report(t):
    """How series are ordered, and their gaps."""
    return info(t).agg(F.count("*").alias("n_series"), F.count_if(F.col("method") == "spatial").alias("n_spatial"), F.round(F.max("gap_cv"), 6).alias("max_gap_cv"), F.count_if(F.col("n_dup") > 0).alias("n_with_duplicates"), F.round(F.min("median_gap"), 6).alias("min_gap"), F.round(F.max("median_gap"), 6).alias("max_gap"))


@query(f"""WITH {H}, s AS (SELECT series_id, list_sort(list(DISTINCT round(slope, 3)) FILTER (WHERE abs(slope - 1) > 1e-6)) AS v, count(CASE WHEN coalesce(slope, 1) <> 1 THEN 1 END) AS n FROM h GROUP BY 1)
SELECT series_id, n AS n_changed, array_to_string(list_transform(v[1:10], lambda x: printf('%.3f', x)), ',') AS slopes FROM s WHERE n > 0""")
def rescale_report(t):
    """Series whose rescaling changes values, with their first ten slopes."""
    s = files(t).groupBy("series_id").agg(F.array_sort(F.collect_set(F.when(F.abs(F.col("slope") - 1) > 1e-6, F.round("slope", 3)))).alias("v"), F.count_if(F.coalesce("slope", F.lit(1.0)) != 1).alias("n_changed"))
    return s.where("n_changed > 0").select("series_id", "n_changed", F.array_join(F.transform(F.slice("v", 1, 10), lambda x: F.format_string("%.3f", x)), ",").alias("slopes"))


@query(f"""WITH {GEO} SELECT concat('S', k) AS series_id, path, CAST(row_number() OVER (PARTITION BY k ORDER BY instance, path) AS INTEGER) AS place FROM q WHERE frames = 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY instance, path) <= 1""")
def first_file_of_series(t):
    """Attribute lookup by condition: the first file of each series, by instance number, that meets it; those without a number come last."""
    d = files(t).where("frames = 1").groupBy("series_id").agg(F.min_by("path", F.struct(F.col("instance").isNull(), "instance", "path")).alias("path"))
    return d.withColumn("place", F.lit(1))


@query(f"""WITH {H} SELECT path, 'missing_size' AS issue FROM h WHERE rows IS NULL UNION ALL SELECT path, 'missing_position' FROM h WHERE z IS NULL UNION ALL SELECT path, 'not_decoded' FROM h WHERE NOT ok""")
def issues_of_all_stages(t):
    """Issues of several stages appended."""
    f = files(t)
    return f.select("path", F.explode(F.array_compact(F.array(F.when(F.col("rows").isNull(), "missing_size"), F.when(F.col("z").isNull(), "missing_position"), F.when(~F.col("ok"), "not_decoded")))).alias("issue"))
