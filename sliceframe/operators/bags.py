"""Weighted sums of a bag's embeddings under a softmax, as accumulators that merge.

An accumulator holds, for each of several heads, the largest score, the sum of
exp(score - largest) and the embeddings weighted by it. Two of them merge into one
of the same size, so a bag is pooled in one pass: accumulators of Arrow batches
are merged by bag and task first, then by bag. No task holds a bag's rows, and no
maximum is joined back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks whose accumulators of one bag meet first.
SALTS = 64
STATE = "bag {}, salt int, n long, top array<double>, total array<double>, sums array<double>"


def rows_of(column, width: int = 0):
    """The rows of an Arrow list column as a matrix of doubles; nulls in it, and null rows, become NaN. ``width`` counts if all rows are null."""
    import numpy as np

    if column.null_count:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        some = rows_of(column.drop_null())
        out = np.full((len(column), some.shape[1] if len(some) else width), np.nan)
        out[there] = some
        return out
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors of one table must have one length")
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def vectors(matrix, of):
    """An Arrow list column of the rows of ``matrix``; null where ``of`` is."""
    import pyarrow as pa

    return pa.array([x if ok else None for x, ok in zip(matrix.tolist(), of.is_valid().to_pylist())], type=pa.list_(pa.float64()))


def _batch(bags, n, top, total, sums, salt):
    import numpy as np
    import pyarrow as pa

    lists = lambda m: pa.array([x.tolist() for x in m], type=pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([bags, pa.array(np.full(len(n), salt, dtype=np.int32)), pa.array(n, type=pa.int64()), lists(top), lists(total), lists(sums)], names=["bag", "salt", "n", "top", "total", "sums"])


def partial(batches):
    """(bag, h, s) to an accumulator for each bag of a batch."""
    import numpy as np
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS
    for batch in batches:
        if not len(batch):
            continue
        coded = batch.columns[0].dictionary_encode(null_encoding="encode")
        codes, h, s = coded.indices.to_numpy(zero_copy_only=False), rows_of(batch.columns[1]), rows_of(batch.columns[2])
        s = np.where(np.isnan(s), -np.inf, s)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        n, top, total, sums = np.diff([*cuts, len(order)]), [], [], []
        for rows in np.split(order, cuts[1:]):
            best = s[rows].max(axis=0)
            e = np.exp(s[rows] - np.where(np.isfinite(best), best, 0))
            top.append(best)
            total.append(e.sum(axis=0))
            sums.append((e.T @ h[rows]).ravel())
        yield _batch(coded.dictionary.take(coded.indices.take(order[cuts])), n, top, total, sums, salt)


def merged(batches):
    """Accumulators in order of (bag, salt) to one of each; only the one at hand is held."""
    import numpy as np
    import pyarrow as pa

    at = None

    def made():
        key, kind, n, top, total, sums = at
        return _batch(pa.array([key[0]], type=kind), [n], [top], [total], [sums.ravel()], key[1])

    for batch in batches:
        if not len(batch):
            continue
        top, total = rows_of(batch.columns[3]), rows_of(batch.columns[4])
        sums = rows_of(batch.columns[5]).reshape(len(batch), top.shape[1], -1)
        for i, (bag, salt, n) in enumerate(zip(*(batch.columns[k].to_pylist() for k in range(3)))):
            if at is not None and at[0] == (bag, salt):
                best = np.maximum(at[3], top[i])
                own, other = (np.exp(np.where(np.isneginf(x), -np.inf, x - np.where(np.isneginf(best), 0, best))) for x in (at[3], top[i]))
                at = (at[0], at[1], at[2] + n, best, at[4] * own + total[i] * other, at[5] * own[:, None] + sums[i] * other[:, None])
            else:
                if at is not None:
                    yield made()
                at = ((bag, salt), batch.columns[0].type, n, top[i], total[i], sums[i])
    if at is not None:
        yield made()


def accumulate(df: DataFrame, bag: str, embedding: Column, scores: Column) -> DataFrame:
    """(bag, n, top, total, sums): an accumulator for each bag; a row without embedding or scores is left out, a null or undefined score has no weight."""
    schema = STATE.format(df.schema[bag].dataType.simpleString())
    rows = df.select(F.col(bag).alias("bag"), embedding.cast("array<double>").alias("h"), scores.cast("array<double>").alias("s")).where("h is not null and s is not null")
    state = rows.mapInArrow(partial, schema)
    for salt in (F.col("salt"), F.lit(0)):
        state = state.withColumn("salt", salt).repartition("bag", "salt").sortWithinPartitions("bag", "salt").mapInArrow(merged, schema)
    return state.select(F.col("bag").alias(bag), "n", "top", "total", "sums")


def pooled(state: DataFrame, bag: str, heads: int, out: str = "pooled") -> DataFrame:
    """(bag, n, ``out``): the weighted mean of each head; null for a head without weight."""
    width = F.expr(f"cast(size(sums) div {heads} as int)")

    def one(k: int) -> Column:
        # Nested lambdas that read each other's variables would keep Spark from running a Python function on the result.
        t = F.get("total", F.lit(k))
        return F.when(t > 0, F.transform(F.slice("sums", k * width + 1, width), lambda x: x / t))

    return state.select(bag, "n", F.array(*[one(k) for k in range(heads)]).alias(out))


def weights(df: DataFrame, bag: str, scores: Column, state: DataFrame, out: str = "attention") -> DataFrame:
    """``df`` with the softmax of each head over the bag, as an array."""
    own = state.select(F.col(bag).alias("_bag"), F.arrays_zip("top", "total").alias("_of"))
    share = F.zip_with(scores.cast("array<double>"), F.col("_of"), lambda s, a: F.coalesce(F.exp(s - a["top"]) / F.nullif(a["total"], F.lit(0.0)), F.lit(0.0)))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(own, F.col(bag).eqNullSafe(F.col("_bag")), "left").select(*kept, share.alias(out))


def linear(weight, bias=None, activation: str | None = None):
    """A layer as a function of an array column: W h + b, then tanh if asked for."""

    @F.arrow_udf("array<double>")
    def apply(column):
        import numpy as np

        x = rows_of(column, weight.shape[1]) @ weight.T + (0 if bias is None else bias)
        return vectors(np.tanh(x) if activation == "tanh" else x, column)

    # Else a filter on the result would run it again.
    return apply.asNondeterministic()


def multihead_pool(df: DataFrame, bag: str, embedding: str, layers: dict, heads: int, mask: Column | None = None) -> DataFrame:
    """(bag, n, pooled): one learned query attends over a bag's embeddings with several heads.

    Keys are linear in the embedding, so a head's score is a product with one fixed vector; values are too, and weights
    sum to one, so they are made of the pooled embedding. Embeddings so pass once, at their own width. A bag without a
    row that ``mask`` holds is not in the result.
    """
    import numpy as np

    query, w, b, out, offset = (np.asarray(layers[k], dtype=np.float64) for k in ("query", "in_proj_weight", "in_proj_bias", "out_proj.weight", "out_proj.bias"))
    d = query.size
    if d % heads:
        raise ValueError(f"{d} dimensions don't divide into {heads} heads")
    q = (w[:d] @ query.ravel() + b[:d]).reshape(heads, -1)
    keys, values, shift = w[d : 2 * d].reshape(heads, -1, d), w[2 * d :].reshape(heads, -1, d), b[2 * d :].reshape(heads, -1)
    asked = np.einsum("hk,hkd->hd", q, keys) / np.sqrt(d / heads)
    on = df if mask is None else df.where(mask)

    @F.arrow_udf("array<double>")
    def project(column):
        import pyarrow as pa

        x = rows_of(column.flatten()).reshape(len(column), heads, d)
        own = np.einsum("nhd,hkd->nhk", x, values) + shift
        return pa.array((own.reshape(len(own), d) @ out.T + offset).tolist(), type=pa.list_(pa.float64()))

    state = accumulate(on, bag, F.col(embedding), linear(asked)(F.col(embedding)))
    # Else an explode of the result would move the function into a filter on its size.
    return pooled(state, bag, heads, "heads").select(bag, "n", project.asNondeterministic()(F.col("heads")).alias("pooled"))
