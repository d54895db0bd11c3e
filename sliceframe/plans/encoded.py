"""Queries over DICOM files: Spark encodes line items as files, the library's sources read them back, the oracle takes the fields from the table.

Most files are of explicit encoding, some of implicit; some are cut within their header or their pixels, some are no DICOM at all.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.functions.vector import bound
from sliceframe.plans import health
from sliceframe.plans.catalog import query
from sliceframe.plans.imaging import COLUMNS, ROWS, WINDOW
from sliceframe.sources import dicom

JUNK, CUT, SHORT = "l_partkey % 83 = 0", "l_partkey % 89 = 0", "l_partkey % 97 = 0"
#: Of element i, from 0: one byte.
PIXEL = "(l_partkey * (i + 1)) % 251"
#: Value representations of the fields that are written (fixed values of the standard); the others are text.
KINDS = {"StudyInstanceUID": "UI", "SeriesInstanceUID": "UI", "SOPInstanceUID": "UI", "TransferSyntaxUID": "UI", "PhotometricInterpretation": "CS", "Modality": "CS", "InstanceNumber": "IS"}
KINDS |= dict.fromkeys(dicom.SHORTS, "US") | dict.fromkeys((*dicom.DOUBLES, *dicom.VECTORS, *dicom.WINDOW), "DS")
FIELDS = {
    "SOPInstanceUID": "path", "Modality": "modality", "SeriesDescription": "description", "SpacingBetweenSlices": "spacing_tag", "StudyInstanceUID": "study_id", "SeriesInstanceUID": "series_id", "InstanceNumber": "instance", "ImagePositionPatient": "ipp",
    "ImageOrientationPatient": "iop", "PhotometricInterpretation": "photometric", "Rows": "r", "Columns": "c", "PixelSpacing": "CASE WHEN spacing IS NOT NULL THEN array(spacing, spacing) END", "BitsAllocated": "8", "PixelRepresentation": "0", "WindowCenter": "window_center", "WindowWidth": "window_width", "RescaleSlope": "slope",
}


#: Every byte by its value, and by l_partkey % 251 the pixels of the largest file: lookups that Spark compiles, where functions of arrays are interpreted.
BYTES, MOST = bytes(range(256)), 24
PIXELS_OF = bytes(key * (i + 1) % 251 for key in range(251) for i in range(MOST))


def small(n: Column) -> Column:
    """Two bytes, the lower one first."""
    byte = lambda x: F.substring(F.lit(BYTES), x.cast("int") + 1, F.lit(1))
    return F.concat(byte(n % 256), byte(F.shiftright(n, 8)))


def element(tag: int, vr: str, raw: Column, explicit: Column) -> Column:
    """An encoded element of even length below 65536; nothing for null."""
    odd = F.length(raw) % 2
    n = small(F.length(raw) + odd)
    head, empty = F.lit(struct.pack("<HH", tag >> 16, tag & 0xFFFF)), F.lit(b"\0\0")
    size = F.concat(F.lit(vr.encode()), empty, n, empty) if vr.encode() in dicom.LONG else F.concat(F.lit(vr.encode()), n)
    return F.coalesce(F.concat(head, F.when(explicit, size).otherwise(F.concat(n, empty)), raw, F.substring(F.lit(b" "), F.lit(1), odd)), F.lit(b""))


def files(t) -> DataFrame:
    """(path, content) of a file for each line item.

    Spark would make one method of all projections, too long for the JVM to compile; a function of an array keeps a projection out of it.
    """
    c, apart = F.col, bound(F.col("path"), lambda p: p).alias("path")
    d = t("lineitem").selectExpr("*", *[f"{e} AS {n}" for n, e in (health.FILE | WINDOW).items() if n not in ("rows", "columns")], f"{ROWS} AS r", f"{COLUMNS} AS c").selectExpr("*", f"{health.IOP} AS iop", f"{health.IPP} AS ipp")
    pixels = F.substring(F.lit(PIXELS_OF), (c("l_partkey") % 251 * MOST).cast("int") + 1, c("r") * c("c"))
    d = d.select(apart, "syntax", *[F.expr(e).alias(n) for n, e in {"junk": JUNK, "cut": CUT, "short": SHORT}.items()], F.coalesce(pixels, F.lit(b"")).alias("bytes"), *[F.expr(e).alias(n) for n, e in FIELDS.items()])
    explicit = c("syntax") != dicom.IMPLICIT

    def raw(name: str) -> Column:
        if KINDS.get(name) == "US":
            return small(c(name))
        text = F.array_join(c(name).cast("array<string>"), "\\") if name in dicom.VECTORS else c(name).cast("string")
        return text.cast("binary")

    # Values first, as an element names its value more than once.
    d = d.select(apart, "junk", "cut", "short", explicit.alias("explicit"), c("syntax").cast("binary").alias("syntax"), "bytes", *[raw(n).alias(n) for n in FIELDS])
    whole = [element(dicom.FIELDS[n], KINDS.get(n, "LO"), c(n), c("explicit")) for n in sorted(FIELDS, key=dicom.FIELDS.get)]
    pixels = element(dicom.PIXELS, "OW", c("bytes"), c("explicit"))
    d = d.select(apart, "junk", "cut", "short", F.concat(F.lit(b"\0" * 128 + b"DICM"), element(dicom.FIELDS["TransferSyntaxUID"], "UI", c("syntax"), F.lit(True)), *whole, pixels).alias("body"))
    body = c("body")
    content = F.when(c("junk"), F.lit(b"no image")).when(c("cut"), F.substring(body, 1, 170)).when(c("short"), F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    return d.select("path", content.alias("content"))


KIND = f"CASE WHEN {JUNK} THEN 'not_dicom' WHEN {CUT} THEN 'unreadable' ELSE 'dicom' END"
#: Vectors as the oracle writes them: numbers in order between spaces.
VECTOR = {"iop": f"({health.IOP})", "ipp": f"({health.IPP})"}
TEXT = {n: f"array_to_string(list_transform({e.replace('array(', 'list_value(')}, lambda x: CAST(round(x, 3) AS VARCHAR)), ' ')" for n, e in VECTOR.items()}
ROWS_OF = f"h AS (SELECT *, {KIND} AS kind, CAST({ROWS} AS INT) AS r, CAST({COLUMNS} AS INT) AS c, {', '.join(f'{e} AS {n}' for n, e in (health.FILE | WINDOW).items() if n not in ('rows', 'columns'))} FROM lineitem)"
READ = {"study": ("StudyInstanceUID", "study_id"), "series": ("SeriesInstanceUID", "series_id"), "instance": ("InstanceNumber", "instance"), "n_rows": ("Rows", "r"), "n_columns": ("Columns", "c"), "modality": ("Modality", "modality"), "syntax": ("TransferSyntaxUID", "syntax"), "photometric": ("PhotometricInterpretation", "photometric"), "description": ("SeriesDescription", "description"), "slope": ("RescaleSlope", "slope"), "spacing_tag": ("SpacingBetweenSlices", "spacing_tag")}


@query(f"""WITH {ROWS_OF} SELECT path, kind, {', '.join(f"CASE WHEN kind = 'dicom' THEN {e} END AS {n}" for n, (_, e) in READ.items())}, {', '.join(f"CASE WHEN kind = 'dicom' THEN {e} END AS {n}" for n, e in TEXT.items())} FROM h""")
def dicom_headers(t):
    """The header of every file, as the source reads it."""
    d = dicom.headers_of(files(t))
    numbers = lambda v: F.array_join(F.transform(v, lambda x: F.round(x, 3).cast("string")), " ")
    return d.select("path", "kind", *[F.col(f).alias(n) for n, (f, _) in READ.items()], numbers("ImageOrientationPatient").alias("iop"), numbers("ImagePositionPatient").alias("ipp"))


@query(f"WITH {ROWS_OF} SELECT count(*) AS files_seen, count(CASE WHEN kind = 'dicom' THEN 1 END) AS dicom_valid, count(CASE WHEN kind = 'unreadable' THEN 1 END) AS dicom_unreadable, count(CASE WHEN kind = 'not_dicom' THEN 1 END) AS not_dicom, count(DISTINCT CASE WHEN kind = 'dicom' THEN study_id END) AS n_studies, count(DISTINCT CASE WHEN kind = 'dicom' THEN series_id END) AS n_series FROM h")
def dicom_scan(t):
    """A scan's counters, with the studies and series that stage 1 makes of its headers."""
    return health.collection.scan_summary(dicom.headers_of(files(t)))


@query(f"""WITH {ROWS_OF}, p AS (SELECT path, row_number() OVER () AS k, * EXCLUDE (path) FROM h), x AS (SELECT k, avg(v) AS mean, min(v) AS least, max(v) AS most, sum(i * v) AS weighted FROM (SELECT k, i, {PIXEL} * coalesce(slope, 1) AS v FROM (SELECT *, unnest(range(0, r * c)) AS i FROM p)) GROUP BY k)
SELECT path, kind = 'dicom' AND NOT ({SHORT}) AS ok, CASE WHEN kind = 'dicom' AND NOT ({SHORT}) THEN round(mean, 6) END AS mean, CASE WHEN kind = 'dicom' AND NOT ({SHORT}) THEN least END AS least, CASE WHEN kind = 'dicom' AND NOT ({SHORT}) THEN most END AS most, CASE WHEN kind = 'dicom' AND NOT ({SHORT}) THEN round(weighted, 4) END AS weighted,
CASE WHEN kind = 'dicom' AND NOT ({SHORT}) THEN window_center END AS window_center, CASE WHEN kind = 'dicom' AND NOT ({SHORT}) THEN window_width END AS window_width FROM p JOIN x USING (k)""")
def dicom_pixels(t):
    """The rescaled pixels and window of every file that can be decoded."""
    d = dicom.decoded(files(t))
    v = F.col("pixels")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return d.select("path", F.col("error").isNull().alias("ok"), F.round(total(v) / F.size(v), 6).alias("mean"), F.array_min(v).alias("least"), F.array_max(v).alias("most"), F.round(total(F.transform(v, lambda x, i: x * i)), 4).alias("weighted"), "window_center", "window_width")
