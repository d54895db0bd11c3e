"""Display previews of slices as columns, and mosaics of a series' slices as PNG images. For the eye only, not for training."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Photometric interpretation whose highest value is black (fixed value of the DICOM standard).
INVERTED = "MONOCHROME1"
#: Pixels between tiles, and the grey of what no tile covers.
GAP, EMPTY = 4, 0


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def with_preview(df: DataFrame, pixels: str = "pixels", name: str = "preview", *, windowed: bool = False, photometric: str = "photometric", center: str = "window_center", width: str = "window_width") -> DataFrame:
    """Adds ``name``: the pixels between 0 and 1 by the range of the finite ones, inverted where the photometric says so.

    With ``windowed``, pixels are clipped to the window first where both its values are there and its width is above 0.
    Images that are flat, or have no finite pixel, become zeros; a non-finite pixel of another image is null.
    A null image stays null, an empty one empty. Only expressions: nothing is shuffled, no Python is started.
    """
    x = F.col(pixels)
    if windowed:
        c, half = F.col(center), F.col(width) / 2
        usable = c.isNotNull() & (F.col(width) > 0)
        x = F.when(usable, F.transform(x, lambda v: F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, c - half), c + half)))).otherwise(x)
    # A column each, so that an image's range is found once and not again for each pixel.
    d = df.withColumn("_x", F.transform(x, lambda v: F.when(finite(v), v)))
    d = d.withColumns({"_low": F.array_min("_x"), "_high": F.array_max("_x"), "_turned": F.coalesce(F.upper(F.col(photometric)) == INVERTED, F.lit(False))})
    low, high = F.col("_low"), F.col("_high")
    turned = F.transform("_x", lambda v: F.when(F.col("_turned"), high - (v - low)).otherwise(v))
    shown = F.when(high > low, F.transform(turned, lambda v: (v - low) / (high - low))).when(F.col("_x").isNotNull(), F.transform("_x", lambda v: F.lit(0.0)))
    return d.withColumn(name, shown).drop("_x", "_low", "_high", "_turned")


def picked(n: Column, k: int) -> Column:
    """At most ``k`` places of 0 to n - 1, evenly spaced with both ends, ties to the even one; all where there are no more."""
    some = F.array_distinct(F.array(*[F.bround(F.lit(float(i)) * ((n - 1) / F.lit(float(max(k - 1, 1)))), 0).cast("int") for i in range(k)]))
    every = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n <= k, every).otherwise(some)


def png(a, texts: dict[str, str] | None = None) -> bytes:
    """An array of bytes [rows, columns] as a grey PNG image, with texts by keyword."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows, columns = a.shape
    # Each line starts with its filter: none.
    lines = b"\0" + b"\0".join(map(bytes, a)) if rows else b""
    said = b"".join(chunk(b"iTXt", k.encode("latin-1") + b"\0\0\0\0\0" + v.encode()) for k, v in (texts or {}).items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + said + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def tile(values, rows: int, columns: int):
    """A preview as bytes: 0 to 1 becomes 0 to 255, null black. Without values a crossed square stands for what could not be decoded."""
    import numpy as np

    if values is None:
        out = np.zeros((rows, columns), dtype=np.uint8)
        y = np.arange(rows)
        x = y * max(columns - 1, 0) // max(rows - 1, 1)
        out[y, x] = out[y, columns - 1 - x] = 255
        return out
    v = np.asarray(values, dtype=np.float64).reshape(rows, columns)
    return np.floor(np.where(np.isfinite(v), v, 0.0) * 255 + 0.5).astype(np.uint8)


def mosaic(tiles: list[dict], per_row: int | None = None):
    """Tiles (preview, rows, columns; null where not decoded) from left to right and top to bottom, each in the middle of a cell of the largest size."""
    return placed([None if t["preview"] is None else tile(t["preview"], t["rows"], t["columns"]) for t in tiles], per_row)


def placed(tiles: list, per_row: int | None = None):
    """Tiles as arrays of bytes [rows, columns], or None for a crossed one, as one image."""
    import numpy as np

    sizes = [t.shape for t in tiles if t is not None]
    h, w = (max(s) for s in zip(*sizes)) if sizes else (32, 32)
    across = min(per_row or len(tiles), len(tiles)) or 1
    down = max(1, -(-len(tiles) // across))
    out = np.full((down * (h + GAP) - GAP, across * (w + GAP) - GAP), EMPTY, dtype=np.uint8)
    for i, t in enumerate(tiles):
        if t is None:
            t = tile(None, h, w)
        r, c = t.shape
        top, left = i // across * (h + GAP) + (h - r) // 2, i % across * (w + GAP) + (w - c) // 2
        out[top : top + r, left : left + c] = t
    return out


MOSAIC = "study_id string, series_id string, name string, title string, n_tiles int, n_errors int, width int, height int, image binary"


def mosaics(tiles: DataFrame, per_row: int | None = None) -> DataFrame:
    """One image a series of its tiles (study_id, series_id, name, title, place, caption, preview, rows, columns, error).

    Groups are as large as the tiles that were picked for a series, never its slices. Title, captions and errors
    stand in the image's texts. A tile without a place says that its series has none: the image is one empty cell.
    """
    # Spark gathers a series' tiles, as shades from 0 to 255; Python is called for a batch of series, not for each.
    shades = F.transform("preview", lambda v: F.when(finite(v), F.floor(v * 255 + 0.5)).otherwise(0).cast("int"))
    said = F.concat_ws(": ", "caption", F.concat(F.lit("decode error: "), F.nullif("error", F.lit(""))))
    one = F.when(F.col("place").isNotNull(), F.struct("place", said.alias("said"), "rows", "columns", shades.alias("shades")))
    bags = tiles.groupBy("study_id", "series_id").agg(F.first("name").alias("name"), F.first("title").alias("title"), F.collect_list(one).alias("tiles"))

    def work(batches):
        import pyarrow as pa

        for b in batches:
            bag = b.column("tiles")
            each = bag.flatten()
            place, lines, rows, columns, found = (each.field(n) for n in ("place", "said", "rows", "columns", "shades"))
            ends, there = found.offsets.to_pylist(), found.is_valid().to_pylist()
            values = found.values.fill_null(0).to_numpy(zero_copy_only=False).astype("uint8")
            place, lines, rows, columns = (x.to_pylist() for x in (place, lines, rows, columns))
            out = {n: [] for n in ("n_tiles", "n_errors", "width", "height", "image")}
            at = 0
            for title, size in zip(b.column("title").to_pylist(), bag.value_lengths().to_pylist()):
                order = sorted(range(at, at + size), key=place.__getitem__)
                at += size
                a = placed([values[ends[i] : ends[i + 1]].reshape(rows[i], columns[i]) if there[i] else None for i in order], per_row)
                image = png(a, {"Title": title or "", "Description": "\n".join(lines[i] for i in order)})
                for n, x in zip(out, (size, sum(not there[i] for i in order), a.shape[1], a.shape[0], image)):
                    out[n].append(x)
            made = [pa.array(v, type=pa.binary() if n == "image" else pa.int32()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("study_id", "series_id", "name", "title")), *made], names=["study_id", "series_id", "name", "title", *out])

    return bags.mapInArrow(work, MOSAIC)


def png_bytes(image: bytes):
    """The pixels of an image that ``png`` made."""
    import numpy as np

    at, size, packed = 8, None, b""
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:]


def texts(image: bytes) -> Iterator[tuple[str, str]]:
    """The texts of such an image by keyword."""
    at = 8
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        if kind == b"iTXt":
            key, rest = image[at + 8 : at + 8 + n].split(b"\0", 1)
            yield key.decode("latin-1"), rest[4:].decode()
        at += 12 + n
