"""Embedding whitening by a tiled covariance.

 1. Vectors become integer vectors x; their number n and the sums S of each
    dimension are exact (high and low halves are summed apart).
 2. Every Arrow batch is cut into row blocks, every row block into column blocks
    of ``TILE`` dimensions, centred by S / n. A pair of column blocks is a tile
    key; tile keys are dealt into stripes, and a row block's column blocks are
    shuffled by (row block, stripe). So the pairs of one row block meet, and a
    task holds the sums of one stripe's tiles, at most ``STRIPE`` numbers.
 3. A task multiplies the tile pairs of its row blocks and adds them up; sums of
    tasks are added per tile in two steps, so that no task reads one tile's sums
    of all tasks. The tiles are assembled and eigendecomposed by the driver, whose
    matrix grows with the square of the dimensions only.
 4. Vectors are projected on the components, and the covariance of the result, by
    the same tiles, is held against the identity.

Defined results: rows whose vector is null, empty, or holds a null or an entry
that is not finite are dropped; so are vectors of another length than the most
frequent one (of equally frequent ones the longer). Integers beyond 64 bits are
cut to them. A component whose eigenvalue is not above the rounding error of the
largest (constant or dependent dimensions, a single row) has no whitened
coordinate: null, left out of the identity error, which is null if there is none.
A deviation beyond 64 bits is null. Null ids and repeated rows are kept, each
counts; an empty table gives an empty result; extra columns of any name pass
through, but for one named as the result, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import as_row, durable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Dimensions of a column block, numbers of a row block and of a task's tile sums, tasks whose sums meet first.
TILE, BLOCK, STRIPE, SALTS = 32, 1 << 20, 1 << 22, 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Whitening:
    """A fit: the vectors' number, exact sums, eigenvalues by falling size, unit eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: object
    trace: float
    usable: int

    def explained(self) -> list[float | None]:
        return [v / self.trace if self.trace > 0 else None for v in self.values]


def matrix(column):
    """The double rows of an Arrow list column without nulls, all of one length."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def integers(c):
    """x = floor(64 c) + 1000000, cut to 64 bits."""
    import numpy as np

    whole = np.floor(SCALE * np.clip(c, -(2.0**70), 2.0**70))
    small = np.abs(whole) < 2.0**62
    out = np.where(small, whole, 0).astype(np.int64) + SHIFT
    for at in zip(*np.nonzero(~small)):
        out[at] = min(max(int(whole[at]) + SHIFT, LEAST), MOST)
    return out


def largest(x) -> float:
    import numpy as np

    return float(np.abs(x.astype(np.float64)).max(initial=0))


def centred(x, n: int, sums: list[int]):
    """x - S / n: whole parts subtracted as integers."""
    import numpy as np

    whole = [s // n for s in sums]
    part = np.array([s % n / n for s in sums])
    if max(largest(x), *map(abs, whole)) < 2.0**61:
        return (x - np.array(whole, dtype=np.int64)) - part
    return (x.astype(np.float64) - np.array(whole, dtype=np.float64)) - part


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the sums by dimension of the most frequent length of column v."""

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            v = batch.columns[0]
            sizes = np.diff(v.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                x = integers(matrix(v.filter(pa.array(sizes == size))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, len(x))), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))], names=["size", "at", "n", "high", "low"])

    parts = vectors.mapInArrow(partial, "size long, at long, n long, high long, low long")
    wide = "decimal(38,0)"
    total = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    best = total.groupBy("size").agg(F.max("n").alias("n"), F.collect_list(F.struct("at", "high", "low")).alias("sums")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not best:
        return 0, []
    return best[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(best[0]["sums"])]


def stripes(d: int, tile: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """First dimensions of the column blocks, and the tile keys (pairs of blocks) of each stripe."""
    tile = min(tile, d)
    starts, keys = list(range(0, d, tile)), []
    for k, key in enumerate(combinations_with_replacement(range(len(starts)), 2)):
        if k % max(1, STRIPE // tile**2) == 0:
            keys.append([])
        keys[-1].append(key)
    return starts, keys


def tiled_covariance(vectors: DataFrame, to_rows, d: int, n: int, tile: int = TILE):
    """The covariance, divisor n, of the centred rows that ``to_rows`` makes of column v (an Arrow array)."""
    import numpy as np

    starts, keys = stripes(d, tile)
    width = min(tile, d)
    needs = [sorted({b for key in stripe for b in key}) for stripe in keys]

    def column_blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, block = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = to_rows(batch.columns[0])
            for lo in range(0, len(rows), max(1, BLOCK // d)):
                part = rows[lo : lo + max(1, BLOCK // d)]
                out = [(task + block, s, b, part[:, starts[b] : starts[b] + width].tobytes()) for s, of in enumerate(needs) for b in of]
                block += 1
                yield pa.RecordBatch.from_pylist([dict(zip(("block", "stripe", "col", "cells"), r)) for r in out], schema=pa.schema([("block", pa.int64()), ("stripe", pa.int32()), ("col", pa.int32()), ("cells", pa.binary())]))

    def products(batches):
        """Column blocks in order of (stripe, row block) to the sums of each tile."""
        import pyarrow as pa
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        sums, stripe, block, held = {}, None, None, {}

        def multiply():
            for a, b in keys[stripe] if held else ():
                got = held[a].T @ held[b]
                sums[a, b] = sums[a, b] + got if (a, b) in sums else got
            held.clear()

        def made():
            out = [{"a": a, "b": b, "salt": salt, "cells": s.tobytes()} for (a, b), s in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary())]))

        for batch in batches:
            for row in batch.to_pylist():
                if (row["stripe"], row["block"]) != (stripe, block):
                    multiply()
                    if stripe not in (None, row["stripe"]):
                        yield made()
                    stripe, block = row["stripe"], row["block"]
                held[row["col"]] = np.frombuffer(row["cells"]).reshape(-1, min(width, d - starts[row["col"]]))
        multiply()
        yield made()

    def added(batches):
        """Rows in order of (a, b, salt) to one sum of each."""
        import pyarrow as pa

        at, total = None, None
        kind = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                key, cells = (row["a"], row["b"], row["salt"]), np.frombuffer(row["cells"])
                if key == at:
                    total = total + cells
                else:
                    if at:
                        yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "salt"), at)) | {"cells": total.tobytes()}], schema=kind)
                    at, total = key, cells
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "salt"), at)) | {"cells": total.tobytes()}], schema=kind)

    sent = vectors.mapInArrow(column_blocks, "block long, stripe int, col int, cells binary")
    tiles = sent.repartition("block", "stripe").sortWithinPartitions("stripe", "block").mapInArrow(products, "a int, b int, salt int, cells binary")
    for salt in (F.col("salt"), F.lit(0)):
        tiles = tiles.withColumn("salt", salt).repartition("a", "b", "salt").sortWithinPartitions("a", "b", "salt").mapInArrow(added, "a int, b int, salt int, cells binary")
    v = np.zeros((d, d))
    for row in tiles.collect():
        a, b = starts[row["a"]], starts[row["b"]]
        cell = np.frombuffer(row["cells"]).reshape(min(width, d - a), -1)
        v[a : a + cell.shape[0], b : b + cell.shape[1]] = cell
        v[b : b + cell.shape[1], a : a + cell.shape[0]] = cell.T
    return v / max(n, 1)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> Whitening:
    """Over all vectors of ``df`` that are not dropped."""
    import numpy as np

    v = df.where(usable(F.col(f"`{vector}`"))).select(F.col(f"`{vector}`").alias("v"))
    n, sums = exact_sums(v)
    d = len(sums)
    if not d:
        return Whitening(0, [], [], np.zeros((0, 0)), 0.0, 0)
    cov = tiled_covariance(v.where(F.size("v") == d), lambda c: centred(integers(matrix(c)), n, sums), d, n, tile)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    usable_ones = int((values > d * np.finfo(float).eps * max(values.max(initial=0), 0)).sum())
    return Whitening(n, sums, values.tolist(), vectors, float(np.trace(cov)), usable_ones)


def transform(df: DataFrame, model: Whitening, *, vector: str = "embedding", out: str = "whitening") -> DataFrame:
    """``df`` without the dropped rows, with a struct ``out``: deviation, whitened (an entry for each component)."""
    kept = df.where(usable(F.col(f"`{vector}`")) & (F.size(F.col(f"`{vector}`")) == len(model.sums)))
    share = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("deviation long, whitened array<double>")
    def apply(column):
        import numpy as np
        import pyarrow as pa

        m = share.value
        x = integers(matrix(column))
        whole = [s // m.n for s in m.sums]
        rest = [s % m.n for s in m.sums]
        # n * x - S = n * (x - S div n) - S mod n
        if max(largest(x), *map(abs, whole)) < 2.0**61:
            y = x - np.array(whole, dtype=np.int64)
            wide = ((np.abs(y.astype(np.float64)) * m.n + m.n) ** 2).sum(axis=1) >= 2.0**62
            y = np.where(wide[:, None], 0, y) * np.int64(m.n) - np.where(wide[:, None], 0, np.array(rest, dtype=np.int64))
            deviation = (y * y).sum(axis=1).tolist()
        else:
            wide, deviation = np.ones(len(x), dtype=bool), [0] * len(x)
        for i in np.flatnonzero(wide):
            deviation[i] = sum((m.n * a - s) ** 2 for a, s in zip(x[i].tolist(), m.sums))
        root = np.sqrt(np.array(m.values[: m.usable]))
        w = centred(x, m.n, m.sums) @ m.vectors[:, : m.usable] / root
        none = [None] * (len(m.values) - m.usable)
        rows = [{"deviation": a if a <= MOST else None, "whitened": b + none} for a, b in zip(deviation, w.tolist())]
        return pa.array(rows, type=pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))

    # Else each field that is read would run it again.
    done = kept.select(as_row(kept).alias("row"), apply.asNondeterministic()(F.col(f"`{vector}`")).alias("found"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c != out], F.col("found").alias(out))


def identity_error(whitened: DataFrame, model: Whitening, column: Column, tile: int = TILE) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    import numpy as np

    k = model.usable
    if not k:
        return None
    v = whitened.select(F.slice(column, 1, k).alias("v"))

    def partial(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(matrix(batch.columns[0]).reshape(-1, k).sum(axis=0))], names=["at", "s"])

    total = {r["at"]: r["s"] for r in v.mapInArrow(partial, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([total[i] for i in range(k)]) / model.n
    return float(np.abs(tiled_covariance(v, lambda c: matrix(c).reshape(-1, k) - mean, k, model.n, tile) - np.eye(k)).max())


def query(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    model = fit(vectors, tile=tile)
    done = durable(transform(vectors.select("vec_id", "embedding"), model).select("vec_id", "whitening"))
    error = identity_error(done, model, F.col("whitening.whitened"), tile)
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained()]) if model.values else F.expr("cast(array() as array<double>)")
    each = done.select("vec_id", "whitening.deviation", F.posexplode("whitening.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
