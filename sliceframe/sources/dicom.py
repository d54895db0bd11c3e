"""DICOM files as rows: a header parser for the uncompressed encodings, and scans built on it.

Files come from Spark's ``binaryFile`` reader, so any file system that Spark reads
will do; a bad file becomes a row with ``kind`` and ``message``, never an error.
Files whose names start with a dot or an underscore are not listed by that reader.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceframe.functions.scalar import general, parse_vector

#: Tags by keyword (fixed values of the DICOM standard), grouped by the type of their column.
TEXT = {
    "StudyInstanceUID": 0x0020000D, "SeriesInstanceUID": 0x0020000E, "SOPInstanceUID": 0x00080018, "SOPClassUID": 0x00080016, "PatientID": 0x00100020,
    "SeriesDescription": 0x0008103E, "Modality": 0x00080060, "BodyPartExamined": 0x00180015, "ProtocolName": 0x00181030, "SequenceName": 0x00180024,
    "PhotometricInterpretation": 0x00280004, "StudyDate": 0x00080020, "StudyDescription": 0x00081030, "Manufacturer": 0x00080070,
    "ManufacturerModelName": 0x00081090, "Laterality": 0x00200060, "PatientPosition": 0x00185100, "TransferSyntaxUID": 0x00020010,
}
INTS = {
    "SeriesNumber": 0x00200011, "Rows": 0x00280010, "Columns": 0x00280011, "InstanceNumber": 0x00200013, "NumberOfFrames": 0x00280008, "SamplesPerPixel": 0x00280002,
    "BitsAllocated": 0x00280100, "BitsStored": 0x00280101, "HighBit": 0x00280102, "PixelRepresentation": 0x00280103,
}
DOUBLES = {"SliceThickness": 0x00180050, "SpacingBetweenSlices": 0x00180088, "RescaleSlope": 0x00281053, "RescaleIntercept": 0x00281052}
VECTORS = {"ImageOrientationPatient": 0x00200037, "ImagePositionPatient": 0x00200032, "PixelSpacing": 0x00280030}
#: Read with pixels only, and no part of a header row.
WINDOW = {"WindowCenter": 0x00281050, "WindowWidth": 0x00281051}
FIELDS = TEXT | INTS | DOUBLES | VECTORS | WINDOW
NAMES = {tag: name for name, tag in FIELDS.items()}
LISTS = VECTORS | WINDOW
#: Value representations with a four-byte length, and formats of binary ones (fixed values).
LONG = frozenset((b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"))
BINARY = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}
SHORTS = frozenset(("Rows", "Columns", "SamplesPerPixel", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation"))
PIXELS, ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = 0x7FE00010, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
IMPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
LEAST_BYTES = 132

SCHEMA = ", ".join(
    ["path string", "kind string", "message string"] + [f"{c} string" for c in TEXT] + [f"{c} int" for c in INTS] + [f"{c} double" for c in DOUBLES] + [f"{c} array<double>" for c in VECTORS]
)


class DicomError(ValueError):
    """Bytes that are not a readable data set."""


class Reader:
    """Walks the elements of one encoded data set."""

    def __init__(self, data: bytes, at: int = 0, explicit: bool = True, order: str = "<", known: dict | None = None):
        self.data, self.at, self.explicit, self.order = data, at, explicit, order
        #: Heads and values that were met before, shared by the files of a task.
        self.known = {} if known is None else known

    def take(self, fmt: str):
        size = struct.calcsize(fmt)
        if self.at + size > len(self.data):
            raise DicomError("data set ends inside an element")
        out = struct.unpack_from(self.order + fmt, self.data, self.at)
        self.at += size
        return out

    def element(self) -> tuple[int, bytes, int]:
        group, number = self.take("HH")
        tag = group << 16 | number
        if not self.explicit or group == 0xFFFE:
            return tag, b"", self.take("I")[0]
        vr = bytes(self.take("2s")[0])
        if not (vr.isalpha() and vr.isupper()):
            raise DicomError(f"no value representation at byte {self.at - 2}")
        if vr in LONG:
            self.at += 2
            return tag, vr, self.take("I")[0]
        return tag, vr, self.take("H")[0]

    def skip(self, size: int) -> None:
        """Past a value; those of undefined length end with their delimiter, however deeply nested."""
        open_ends = 1 if size == UNDEFINED else 0
        if not open_ends:
            self.at += size
        while open_ends:
            tag, _, n = self.element()
            if tag in (ITEM_END, SEQUENCE_END):
                open_ends -= 1
            elif n == UNDEFINED:
                open_ends += 1
            else:
                self.at += n
        if self.at > len(self.data):
            raise DicomError("value reaches past the end of the file")


def typed(name: str, vr: bytes, raw: bytes, order: str):
    """The value as the type of its column; null if empty or not of that type."""
    fmt = BINARY.get(vr) or ("H" if not vr and name in SHORTS else None)
    if fmt == "H" and len(raw) == 2:
        parts = [int.from_bytes(raw, "little" if order == "<" else "big")]
    elif fmt:
        n = len(raw) // struct.calcsize(fmt)
        parts = list(struct.unpack_from(f"{order}{n}{fmt}", raw))
    else:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        text = text.strip(" \0\t\r\n")
        if name in TEXT:
            return text or None
        parts = text.split("\\") if text else []
    try:
        if name in INTS:
            n = int(parts[0]) if len(parts) == 1 else None
            return n if n is not None and -(2**31) <= n < 2**31 else None
        numbers = [float(p) for p in parts]
    except ValueError:
        return None
    if name in VECTORS or name in WINDOW:
        return numbers or None
    return numbers[0] if len(numbers) == 1 else None


#: So many element heads, and values of each, are held, as they repeat from file to file; longer values than so many bytes are not.
HELD_VALUES, HELD_BYTES = 1 << 12, 64


def read_fields(reader: Reader, out: dict, meta_only: bool = False) -> tuple[int, int] | None:
    """Fills ``out``; returns (offset, length) of the pixels where the header ends with them. One loop without calls, as it meets every element of every file.

    Heads (tag, representation and length) of plain elements and their converted values are looked up where an earlier element was the same.
    """
    data, explicit, order, at, end = reader.data, reader.explicit, reader.order, reader.at, len(reader.data)
    unpack, head, long = struct.unpack_from, f"{order}HH2sH", f"{order}I"
    heads = reader.known.setdefault((explicit, order), {})
    while at + 8 <= end:
        first = data[at : at + 8]
        if meta_only and first[:2] != b"\2\0":
            break
        if (plain := heads.get(first)) is None:
            group, number, vr, size = unpack(head, data, at)
            tag, value = group << 16 | number, at + 8
            if not explicit or group == 0xFFFE:
                vr, size = b"", unpack(long, data, at + 4)[0]
            elif vr in LONG:
                if (value := at + 12) > end:
                    raise DicomError("data set ends inside an element")
                size = unpack(long, data, at + 8)[0]
            elif not (vr.isalpha() and vr.isupper()):
                raise DicomError(f"no value representation at byte {at + 4}")
            reader.at = value
            if tag == PIXELS:
                return value, size
            if size == UNDEFINED:
                reader.skip(size)
                at = reader.at
                continue
            name = NAMES.get(tag)
            plain = size, name, vr, name in LISTS, {}
            if value == at + 8:
                if len(heads) >= HELD_VALUES:
                    heads.clear()
                heads[first] = plain
        else:
            value = at + 8
        size, name, vr, several, values = plain
        if (at := value + size) > end:
            raise DicomError("value reaches past the end of the file")
        if name is None:
            continue
        raw = data[value:at]
        if (found := values.get(raw, values)) is values:
            found = typed(name, vr, raw, order)
            if size <= HELD_BYTES:
                if len(values) >= HELD_VALUES:
                    values.clear()
                values[raw] = found
        # A list is copied, as its reader may change it.
        out[name] = found[:] if several and found else found
    reader.at = at
    return None


def parse(data: bytes, known: dict | None = None) -> tuple[dict, bytes, tuple[int, int] | None, str]:
    """(fields, data set, place of the pixels in it, byte order); files without preamble are read as a bare data set."""
    out: dict = {}
    if data[128:132] != b"DICM":
        explicit = data[4:6].isalpha() and data[4:6].isupper()
        return out, data, read_fields(Reader(data, 0, explicit, known=known), out), "<"
    meta = Reader(data, 132, known=known)
    read_fields(meta, out, meta_only=True)
    syntax, at = out.get("TransferSyntaxUID"), meta.at
    if syntax == DEFLATED:
        data, at = zlib.decompress(data[at:], -15), 0
    order = ">" if syntax == BIG_ENDIAN else "<"
    return out, data, read_fields(Reader(data, at, syntax != IMPLICIT, order, known), out), order


def header(data: bytes, known: dict | None = None) -> dict:
    """kind (dicom, unreadable, not_dicom), message and the fields."""
    preamble = data[128:132] == b"DICM"
    if len(data) < LEAST_BYTES and not preamble:
        return {"kind": "not_dicom"}
    try:
        fields = parse(data, known)[0]
    except (DicomError, struct.error, zlib.error) as e:
        return {"kind": "unreadable", "message": f"header: {e}"} if preamble else {"kind": "not_dicom"}
    if not preamble and not (fields.get("SOPInstanceUID") or fields.get("SOPClassUID")):
        return {"kind": "not_dicom"}
    return {"kind": "dicom", **fields}


def decode(data: bytes):
    """(first frame, rescaled, as float64 [rows, columns]; fields); DicomError if it can't be decoded."""
    import numpy as np

    try:
        f, body, place, order = parse(data)
    except (struct.error, zlib.error) as e:
        raise DicomError(str(e)) from e
    rows, columns, bits = f.get("Rows"), f.get("Columns"), f.get("BitsAllocated")
    if not place or place[1] == UNDEFINED or bits not in (8, 16, 32) or not rows or not columns or (f.get("SamplesPerPixel") or 1) != 1:
        raise DicomError("pixels are missing, compressed or of an unknown layout")
    kind = np.dtype(f"{order}{'i' if f.get('PixelRepresentation') else 'u'}{bits // 8}")
    if place[1] < rows * columns * kind.itemsize or place[0] + rows * columns * kind.itemsize > len(body):
        raise DicomError("too few pixels")
    a = np.frombuffer(body, dtype=kind, count=rows * columns, offset=place[0]).reshape(rows, columns).astype(np.float64)
    slope, intercept = f.get("RescaleSlope"), f.get("RescaleIntercept")
    return a * (1.0 if slope is None else slope) + (0.0 if intercept is None else intercept), f


def pixels(data: bytes):
    return decode(data)[0]


#: Folders that hold no images (fixed values); folders that start with a dot are left out as well.
SKIPPED = ("__pycache__", "venv")


def kept_paths(files: DataFrame, root: str) -> DataFrame:
    """Without files in skipped folders below ``root``."""
    below = F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit(""))
    folders = F.split(F.regexp_replace(below, "/[^/]*$", ""), "/")
    return files.where(~F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED)))


def files(spark: SparkSession, root: str) -> DataFrame:
    """Every candidate file below ``root``; Spark raises if it does not exist."""
    return kept_paths(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root)


def arrow_schema(ddl: str):
    """The Arrow schema of a flat list of columns, built where no session exists."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def headers_of(found: DataFrame) -> DataFrame:
    """(path, content) to header rows, file by file, so that a batch of contents is held once."""

    def work(batches):
        import pyarrow as pa

        schema, known = arrow_schema(SCHEMA), {}
        for b in batches:
            rows = [{"path": p.as_py(), **header(c.as_py() or b"", known)} for p, c in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.select("path", "content").mapInArrow(work, SCHEMA)


def scan_headers(spark: SparkSession, root: str) -> DataFrame:
    return headers_of(files(spark, root))


def scan_counts(headers: DataFrame) -> DataFrame:
    k = F.col("kind")
    return headers.agg(F.count("*").alias("files_seen"), F.count_if(k == "dicom").alias("dicom_valid"), F.count_if(k == "unreadable").alias("dicom_unreadable"), F.count_if(k == "not_dicom").alias("not_dicom"))


def issues(headers: DataFrame) -> DataFrame:
    return headers.where("kind = 'unreadable'").select("path", F.lit("discovery").alias("stage"), "message", "kind")


#: Columns of the header export (names and order are fixed values).
EXPORTED = (
    "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "SeriesDescription", "SeriesNumber", "Modality", "BodyPartExamined", "ProtocolName", "SequenceName",
    "PhotometricInterpretation", "PatientID", "StudyDate", "StudyDescription", "Manufacturer", "ManufacturerModelName", "Laterality", "PatientPosition", "TransferSyntaxUID",
    "Rows", "Columns", "InstanceNumber", "NumberOfFrames", "ImageOrientationPatient", "ImagePositionPatient", "PixelSpacing", "SliceThickness", "SpacingBetweenSlices",
    "SamplesPerPixel", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "RescaleSlope", "RescaleIntercept",
)
#: Columns of the header cache of stage 2 (fixed values).
CACHED = (
    "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "SeriesDescription", "Modality", "PhotometricInterpretation", "TransferSyntaxUID", "Rows", "Columns", "InstanceNumber",
    "ImageOrientationPatient", "ImagePositionPatient", "PixelSpacing", "SliceThickness", "SpacingBetweenSlices", "RescaleSlope", "RescaleIntercept", "Laterality", "PatientPosition",
)


def below(path: Column, root: str) -> Column:
    """A path as it stands below ``root``, however either names the local file system."""
    plain = lambda x: F.regexp_replace(x, "^file:/+", "/")
    base = F.concat(plain(F.lit(root.rstrip("/"))), F.lit("/"))
    return F.when(F.startswith(plain(path), base), F.substr(plain(path), F.length(base) + 1)).otherwise(path)


def header_export(headers: DataFrame, root: str, fields: tuple[str, ...] = EXPORTED) -> DataFrame:
    """A row a readable file: its path below ``root`` and the fields; vectors are numbers of eight digits between semicolons."""
    one = [F.array_join(F.transform(n, lambda v: general(v, 8)), ";").alias(n) if n in VECTORS else F.col(n) for n in fields]
    return headers.where("kind = 'dicom'").select(below(F.col("path"), root).alias("path"), *one)


def read_header_export(spark: SparkSession, path: str, fields: tuple[str, ...] = EXPORTED) -> DataFrame:
    """The table that ``header_export`` became as CSV, typed as headers are; identifiers stay text, and a vector that does not parse is null."""
    kind = lambda n: "int" if n in INTS else "double" if n in DOUBLES else "string"
    raw = spark.read.csv(path, header=True, schema=", ".join(["path string"] + [f"{n} {kind(n)}" for n in fields]), escape='"', multiLine=True, enforceSchema=False)
    return raw.select("path", F.lit("dicom").alias("kind"), *[parse_vector(F.col(n)).alias(n) if n in VECTORS else F.col(n) for n in fields])


def header_cache(spark: SparkSession, root: str, dest: str) -> DataFrame:
    """Headers from the CSV folder ``dest``, which a scan of ``root`` fills where it is absent."""
    header_export(scan_headers(spark, root), root, CACHED).write.mode("ignore").csv(dest, header=True, escape='"')
    return read_header_export(spark, dest, CACHED)


def issue_report(headers: DataFrame) -> DataFrame:
    """A row an issue beside one with the scan's counters, so that no report holds all issues in one value."""
    found = issues(headers).select(F.lit("issue").alias("part"), "path", "stage", "message", "kind")
    counts = scan_counts(headers)
    return counts.select(F.lit("counts").alias("part"), *counts.columns).unionByName(found, allowMissingColumns=True)


PIXEL_SCHEMA = "path string, ok boolean, message string, n long, n_finite long, min double, max double, mean double, std double, p1 double, p99 double, sha256 string"


def pixel_table(found: DataFrame) -> DataFrame:
    """Statistics of the rescaled pixels and their digest; files that can't be decoded say why."""

    def work(batches):
        import hashlib

        import pyarrow as pa

        from sliceframe.operators.pixels import pixel_statistics

        schema = arrow_schema(PIXEL_SCHEMA)
        for b in batches:
            rows = []
            for p, c in zip(b.column(0), b.column(1)):
                try:
                    a = pixels(c.as_py() or b"")
                    rows.append({"path": p.as_py(), "ok": True, **pixel_statistics(a), "sha256": hashlib.sha256(a.tobytes()).hexdigest()})
                except DicomError as e:
                    rows.append({"path": p.as_py(), "ok": False, "message": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.select("path", "content").mapInArrow(work, PIXEL_SCHEMA)


#: A batch of decoded files ends with the file that brings it to so many bytes of pixels, or rows.
HELD, BATCH = 8 << 20, 1000
DECODED = "path string, rows int, columns int, pixels array<double>, slope double, photometric string, window_center double, window_width double, error string"


def decoded(found: DataFrame) -> DataFrame:
    """(path, content) to the first frame's rescaled pixels, in batches of bounded size; a file that can't be decoded says why."""

    def work(batches):
        import pyarrow as pa

        schema = arrow_schema(DECODED)
        rows, held = [], 0
        for b in batches:
            for p, c in zip(b.column(0), b.column(1)):
                row = {"path": p.as_py()}
                try:
                    a, fields = decode(c.as_py() or b"")
                    slope = fields.get("RescaleSlope")
                    row |= {"rows": a.shape[0], "columns": a.shape[1], "pixels": a.ravel(), "slope": 1.0 if slope is None else float(slope), "photometric": fields.get("PhotometricInterpretation")}
                    # Of several windows the first.
                    row |= {"window_center": (fields.get("WindowCenter") or [None])[0], "window_width": (fields.get("WindowWidth") or [None])[0]}
                    held += a.nbytes
                except DicomError as e:
                    row["error"] = str(e)
                rows.append(row)
                if held >= HELD or len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.select("path", "content").mapInArrow(work, DECODED)
