"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

A window is ``WINDOW`` bytes of one text; a byte goes if a window that covers it
starts anywhere else too. Suffixes are put into buckets of equal beginnings, and a
bucket is refined by the buckets of later offsets: the identifier of the 2d bytes at
i names the pair of those of the d bytes at i and at i + d, so that every depth
reuses the identifiers of the one before, from 16 bytes to a whole window. Spark
sorts the buckets: each step groups members by (bucket, identifier at the next
depth), only buckets with several members go on, and counts are summed before they
are shuffled, so that no task holds a bucket.

 1. Windows next to each other are members together: the leftmost offset of the
    smallest 16-byte identifier in a window is its anchor, the same wherever the
    window starts; neighbours with one anchor form a run. First buckets are the 64
    bytes at anchors.
 2. Runs equal as a whole are repeated as a whole. Buckets of one kind of run are done.
 3. Other runs fall into cells, 16 neighbouring distances from the anchor each. A
    cell whose core (what its windows have in common) has no equal repeats nothing; one
    whose windows are all together equal to another's is repeated.
 4. Only cells with an equal core and no equal whole are refined to their windows.
 5. The verdicts return to the texts, where covered bytes are removed.

Strings are equal if their 64-bit identifiers in one bucket of 64-bit identifiers
are. Texts meet their runs by a 96-bit digest; copies in one Arrow batch are counted
at once, and one copy of each different run is carried on.

Defined results: null and empty text has no bytes; texts shorter than a window stay;
repeated rows are other places, so their windows are repeated, and so is a window that
overlaps an equal one; matches never cross texts; what is kept is binary, as a cut
may fall inside a character; texts of any length are taken whole, in pieces that
overlap by a window; null ids are kept; an empty table gives an empty result; extra
columns of any name pass through, but for one named as the result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import as_row, durable, few, written

WINDOW, GRAM, BUCKET, CELL = 400, 16, 64, 16
#: Bytes that are numbered at once.
PIECE = 1 << 20
#: The bits of an offset in a piece, below the upper bits of an identifier.
PLACE = (1 << 31) - 1
RUN = "h long, g int, anchor long, seg long, lo int, n int, d int, reps int, c long"
CELLS = "anchor long, seg long, cell int, core long, whole long, w int, j int, n int"
FOUND = "n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


def mixed(h):
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def paired(a, b):
    """The identifier of what ``a`` names followed by what ``b`` names."""
    import numpy as np

    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def gram_ids(data: bytes):
    """The identifiers of the 16 bytes at every offset."""
    import numpy as np

    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return paired(mixed(eight[:-8]), eight[8:])


def refined(ids, at, depth: int):
    """The identifiers of ``depth`` bytes (16 times a power of two) at the offsets ``at``, depth by depth from those of 16."""
    import numpy as np

    x = ids[at + GRAM * np.arange(depth // GRAM)[:, None]]
    while len(x) > 1:
        x = paired(x[0::2], x[1::2])
    return x[0]


def between(ids, start, end):
    """The identifiers of the 256 to 512 bytes from ``start`` to ``end``."""
    return paired(refined(ids, start, 256), refined(ids, end - 256, 256))


def least(values, width: int):
    """The least of every ``width`` neighbours."""
    import numpy as np

    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: span - width], values[width - span :]) if span < width else values


def runs(pieces: list[bytes]):
    """Runs of all windows: piece, bucket of the anchor, identifier, first window, number of windows, distance of the anchor."""
    import numpy as np

    data = b"".join(pieces)
    size = np.array([len(p) for p in pieces])
    start = np.cumsum(size) - size
    ids = gram_ids(data)
    low = least((ids & np.uint64(((1 << 64) - 1) ^ PLACE)) | np.arange(len(ids), dtype=np.uint64), WINDOW - BUCKET + 1)
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[start] += 1
    np.add.at(edge, start + size - WINDOW + 1, -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    at = (low[inside] & np.uint64(PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff([*first, len(at)])
    lo, at = inside[first], at[first]
    # Up to 4 * 256 bytes, the last 256 of which may overlap the others.
    last = lo + n - 1 + WINDOW - 256
    seg = refined(ids, lo, 256)
    for k in (256, 512):
        seg = paired(seg, refined(ids, np.minimum(lo + k, last), 256))
    seg = paired(paired(seg, refined(ids, last, 256)), (n * 1024 + at - lo).astype(np.uint64))
    of = np.searchsorted(start, lo, side="right") - 1
    return of, refined(ids, at, BUCKET), seg, lo - start[of], n, at - lo


def arrow(names, columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def place_rows(batches):
    """(h, g, text) to the runs of each different text of a batch; equal runs that follow each other are one row."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    def made(held):
        of, anchor, seg, lo, n, d = runs([x[-1] for x in held])
        again = (of[1:] == of[:-1]) & (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1]) & (lo[1:] == lo[:-1] + n[:-1])
        keep = np.flatnonzero(np.concatenate([[True], ~again]))
        reps = np.diff([*keep, len(of)])
        of, anchor, seg, lo, n, d = (x[keep] for x in (of, anchor, seg, lo, n, d))
        h, g, k, off = (np.array(c, dtype=np.int64)[of] for c in list(zip(*held))[:4])
        return arrow(["h", "g", "anchor", "seg", "lo", "n", "d", "reps", "c"], [h, g.astype(np.int32), anchor.view(np.int64), seg.view(np.int64), *(x.astype(np.int32) for x in (lo + off, n, d, reps)), reps * k])

    for batch in batches:
        keys = list(zip(batch.columns[0].to_pylist(), batch.columns[1].to_pylist()))
        left, texts, held, size = Counter(keys), batch.columns[2].cast(pa.binary()), [], 0
        for i, key in enumerate(keys):
            k = left.pop(key, 0)
            text = texts[i].as_py() if k else None
            for off in range(0, len(text or b"") - WINDOW + 1, PIECE):
                piece = text[off : off + PIECE + WINDOW - 1]
                held.append((*key, k, off, piece))
                size += len(piece)
                if size >= PIECE:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)


def run_bytes(batches):
    """(text, runs of it) to the bytes of each run."""
    import pyarrow as pa

    kind = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("w", pa.int32()), ("d", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])
    for batch in batches:
        texts, out, size = batch.columns[0].cast(pa.binary()), [], 0
        for i, rs in enumerate(batch.columns[1]):
            text = texts[i].as_py()
            for r in rs.as_py():
                out.append({k: r[k] for k in ("anchor", "seg", "w", "d", "n")} | {"bytes": text[r["lo"] : r["lo"] + r["n"] + WINDOW - 1]})
                size += len(out[-1]["bytes"])
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def numbered(batches):
    """Batches of runs, about a piece at a time: their identifiers at depth 16, their first offsets, and the columns."""
    import numpy as np

    for batch in batches:
        size = np.array([len(x) for x in batch["bytes"].to_pylist()], dtype=np.int64)
        lo = 0
        while lo < len(size):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), PIECE)))
            part = batch.slice(lo, hi - lo)
            yield gram_ids(b"".join(part["bytes"].to_pylist())), np.cumsum(size[lo:hi]) - size[lo:hi], part
            lo = hi


def cell_rows(batches):
    """Runs to their cells: distances ``CELL * cell`` to ``CELL * cell + CELL - 1`` from the anchor."""
    import numpy as np

    for ids, start, part in numbered(batches):
        anchor, seg, w, d, n = (part[c].to_numpy() for c in ("anchor", "seg", "w", "d", "n"))
        out = []
        for cell in range((WINDOW - BUCKET) // CELL + 1):
            near, far = np.maximum(d - n + 1, CELL * cell), np.minimum(d, CELL * cell + CELL - 1)
            at = np.flatnonzero(far >= near)
            a, b, zero = near[at].astype(np.int64), far[at].astype(np.int64), start[at] + d[at]
            # All windows of the cell, there or not, hold these bytes; this run's own reach from the farthest to the end of the nearest.
            core = between(ids, zero - CELL * cell, zero - CELL * cell - CELL + 1 + WINDOW)
            whole = paired(between(ids, zero - b, zero - a + WINDOW), (b * 1024 + a).astype(np.uint64))
            out.append((anchor[at], seg[at], np.full(len(at), cell, dtype=np.int32), core.view(np.int64), whole.view(np.int64), w[at], (d[at] - b).astype(np.int32), (b - a + 1).astype(np.int32)))
        yield arrow(["anchor", "seg", "cell", "core", "whole", "w", "j", "n"], [np.concatenate(c) for c in zip(*out)])


def window_rows(batches):
    """Runs with some of their cells to those cells' windows: (anchor, distance, identifier, seg, w, j)."""
    import numpy as np

    for ids, start, part in numbered(batches):
        rows = []
        for i, cells in enumerate(part["cells"].to_pylist()):
            d, n = part["d"][i].as_py(), part["n"][i].as_py()
            for cell, w in ((x["cell"], x["w"]) for x in cells):
                for distance in range(max(d - n + 1, CELL * cell), min(d, CELL * cell + CELL - 1) + 1):
                    rows.append((i, distance, w, d - distance))
        i, distance, w, j = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((),) * 4))
        at = start[i] + j
        yield arrow(["anchor", "distance", "id", "seg", "w", "j"], [part["anchor"].to_numpy()[i], distance.astype(np.int32), between(ids, at, at + WINDOW).view(np.int64), part["seg"].to_numpy()[i], w.astype(np.int32), j.astype(np.int32)])


def cut(text: bytes, found) -> tuple[bytes, list[tuple[int, int]]]:
    """The kept bytes and the removed spans."""
    import numpy as np

    if not found:
        return text, []
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    for r in found:
        again = r["n"] * np.arange(r["reps"])
        for x in r["ranges"]:
            np.add.at(edge, again + r["lo"] + x["j"], 1)
            np.add.at(edge, again + r["lo"] + x["j"] + x["n"] - 1 + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), [tuple(x) for x in turns.tolist()]


def cutter():
    @F.arrow_udf(FOUND)
    def apply(texts, found):
        import pyarrow as pa

        texts, kinds = texts.cast(pa.binary()), pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
        rows = []
        for i in range(len(texts)):
            text = texts[i].as_py() or b""
            kept, spans = cut(text, found[i].as_py())
            rows.append({"n_bytes": len(text), "n_removed": len(text) - len(kept), "spans": [{"start": a, "end": b} for a, b in spans], "kept": kept})
        return pa.array(rows, type=kinds)

    # Else every field that is read would cut the texts again.
    return apply.asNondeterministic()


def repeated(docs: DataFrame, text: str, broadcast_rows: int) -> DataFrame:
    """(h, g, found): of each text with a repeated window its runs and, in them, the ranges of repeated windows."""
    t = F.col(f"`{text}`")
    keyed = docs.select(F.xxhash64(t).alias("h"), F.hash(t).alias("g"), t.alias("text"))
    places = written(keyed.mapInArrow(place_rows, RUN))
    kinds = places.groupBy("anchor", "seg").agg(F.sum("c").alias("c"), F.min(F.struct("h", "g", "lo")).alias("at"), F.first("n").alias("n"), F.first("d").alias("d"))
    kinds = written(kinds.join(places.groupBy("anchor").agg(F.sum("c").alias("m")).where("m > 1"), "anchor").select("anchor", "seg", "c", "n", "d", "at"))
    # Buckets with several kinds of run: one copy of each goes on.
    several = kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    one = kinds.join(several, "anchor").select("at.h", "at.g", F.struct("anchor", "seg", F.least("c", F.lit(2)).cast("int").alias("w"), "d", "n", "at.lo").alias("r"))
    lists = few(durable(one.groupBy("h", "g").agg(F.collect_list("r").alias("runs"))), broadcast_rows)
    fetched = keyed.join(lists, ["h", "g"]).select("text", "runs").mapInArrow(run_bytes, "anchor long, seg long, w int, d int, n int, bytes binary")
    members = written(fetched.groupBy("anchor", "seg").agg(*[F.first(c).alias(c) for c in ("w", "d", "n", "bytes")]))

    cells = written(members.mapInArrow(cell_rows, CELLS))
    wholes = written(cells.groupBy("anchor", "cell", "core", "whole").agg(F.sum("w").alias("m"), F.min("seg").alias("seg")))
    alike = wholes.groupBy("anchor", "cell", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", "cell", "core")
    wanted = wholes.join(alike, ["anchor", "cell", "core"]).select("anchor", "seg", F.struct("cell", F.least("m", F.lit(2)).cast("int").alias("w")).alias("x"))
    open_runs = members.drop("w").join(wanted.groupBy("anchor", "seg").agg(F.collect_list("x").alias("cells")), ["anchor", "seg"])
    windows = written(open_runs.mapInArrow(window_rows, "anchor long, distance int, id long, seg long, w int, j int"))
    twice = windows.groupBy("anchor", "distance", "id").agg(F.sum("w").alias("m")).where("m > 1").select("anchor", "distance", "id")

    whole_runs = kinds.where("c > 1").select("anchor", "seg", F.lit(0).alias("j"), "n")
    whole_cells = cells.where("w = 1").join(wholes.where("m > 1").select("anchor", "cell", "core", "whole"), ["anchor", "cell", "core", "whole"]).select("anchor", "seg", "j", "n")
    single = windows.where("w = 1").join(twice, ["anchor", "distance", "id"]).select("anchor", "seg", "j", F.lit(1).alias("n"))
    verdicts = whole_runs.unionAll(whole_cells).unionAll(single).groupBy("anchor", "seg").agg(F.collect_list(F.struct("j", "n")).alias("ranges"))
    found = places.join(written(verdicts), ["anchor", "seg"]).groupBy("h", "g").agg(F.collect_set(F.struct("lo", "n", "reps", "ranges")).alias("found"))
    return found


def dedup(docs: DataFrame, *, text: str = "text", out: str = "dedup", broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with a struct ``out``: n_bytes, n_removed, the removed spans (byte offsets) and the kept bytes. A column of that name is replaced."""
    t, row = F.col(f"`{text}`"), F.col("row")
    found = repeated(docs, text, broadcast_rows)
    joined = docs.select(as_row(docs).alias("row"), F.xxhash64(t).alias("h"), F.hash(t).alias("g")).join(found, ["h", "g"], "left")
    done = joined.select("row", cutter()(row.getField(text), F.col("found")).alias("cut"))
    return done.select(*[row.getField(c).alias(c) for c in docs.columns if c != out], F.col("cut").alias(out))


def query(docs: DataFrame) -> DataFrame:
    done = dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"), F.sha2(F.col("dedup.kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400),
k AS (SELECT r, i, md5(b[i : i + 399]) AS k FROM s),
rep AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM k SEMI JOIN rep USING (k)),
span AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit),
gone AS (SELECT r, g, min(i) AS a, max(i) + 400 AS z FROM span GROUP BY r, g),
edge AS (SELECT r, z AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS z FROM gone UNION ALL SELECT r, 1, min(a) FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(hex(b[edge.a : coalesce(edge.z, octet_length(b) + 1) - 1]), '' ORDER BY edge.a) AS h FROM edge JOIN d USING (r) WHERE edge.a < coalesce(edge.z, octet_length(b) + 1) GROUP BY r),
sums AS (SELECT r, sum(z - a) AS n, count(*) AS spans FROM gone GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
