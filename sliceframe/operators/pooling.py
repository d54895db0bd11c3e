"""Pooling of instance embeddings (array columns) into bags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.operators import bags


def mean_pool(df: DataFrame, bag: str, embedding: str, digits: int = 6) -> DataFrame:
    """Element-wise mean in long form (bag, i, value); partial sums are combined before the shuffle."""
    d = df.select(bag, F.posexplode(embedding).alias("i", "v"))
    return d.groupBy(bag, "i").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("value"))


def scores(embedding: Column, query: list[float], temperature: float = 1.0) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(embedding, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) / temperature


def attention(df: DataFrame, bag: str, score: Column) -> DataFrame:
    """Adds the softmax of ``score`` over the bag: one pass for the bags' accumulators, one join of those."""
    scores = F.array(score)
    state = bags.accumulate(df, bag, F.expr("cast(array() as array<double>)"), scores)
    return bags.weights(df, bag, scores, state).withColumn("attention", F.element_at("attention", 1))


def attention_pool(df: DataFrame, bag: str, embedding: str, score: Column, digits: int = 6) -> DataFrame:
    one = bags.pooled(bags.accumulate(df, bag, F.col(embedding), F.array(score)), bag, 1)
    return one.select(bag, F.posexplode(F.get("pooled", F.lit(0))).alias("i", "value")).withColumn("value", F.round("value", digits))


def attention_checks(df: DataFrame, bag: str) -> DataFrame:
    """Sums to one, and counts of undefined weights, for each bag."""
    bad = F.count_if(F.col("attention").isNull() | F.isnan("attention"))
    return df.groupBy(bag).agg(F.count("*").alias("n"), bad.alias("n_bad"), (F.abs(F.sum("attention") - 1) < 1e-4).alias("sums_to_one"))


#: Rows of plane embeddings (fixed values).
PLANE_INDEX = {"Sagittal": 0, "Coronal": 1, "Axial": 2}


def masked_mean(df: DataFrame, bag: str, embedding: str, mask: Column, digits: int = 6) -> DataFrame:
    """Mean over the rows that ``mask`` holds; zeros for a bag without any."""
    d = df.select(bag, F.coalesce(mask, F.lit(False)).alias("_on"), F.posexplode(embedding).alias("i", "v"))
    return d.groupBy(bag, "i").agg(F.round(F.coalesce(F.avg(F.when(F.col("_on"), F.col("v").cast("double"))), F.lit(0.0)), digits).alias("value"))


def plane_index(derived: Column, listed: Column) -> Column:
    """The derived plane's row, else the listed one's, else that of Sagittal; names outside the list count as Sagittal."""
    name = F.coalesce(F.nullif(derived, F.lit("")), F.nullif(listed, F.lit("")), F.lit("Sagittal"))
    known = F.create_map(*[F.lit(x) for kv in PLANE_INDEX.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit(0))


def label_scores(embedding: Column, projection: list[list[float]], bias: list[float], queries: dict[str, list[float]], *, added: Column | None = None, temperature: float = 1.0) -> dict[str, Column]:
    """Per label q . tanh(W h' + b) / temperature, where h' is the embedding plus ``added``."""
    h = embedding if added is None else F.zip_with(embedding, added, lambda a, b: a.cast("double") + b)
    z = [F.tanh(scores(h, row) + float(b)) for row, b in zip(projection, bias, strict=True)]
    dot = lambda q: sum((x * float(c) for x, c in zip(z, q, strict=True)), F.lit(0.0))
    return {label: dot(q) / temperature for label, q in queries.items()}


def label_attention_pool(df: DataFrame, bag: str, embedding: str, by_label: dict[str, Column], mask: Column | None = None, digits: int = 6) -> DataFrame:
    """(bag, label, i, value): for each label the embeddings (without what was added) weighted by the softmax of its scores
    over the bag's rows that ``mask`` holds. A bag without such a row has none in the result.

    One accumulator a bag holds all labels, so an embedding is not repeated for each.
    """
    on = df if mask is None else df.where(mask)
    one = bags.pooled(bags.accumulate(on, bag, F.col(embedding), F.array(*by_label.values())), bag, len(by_label))
    each = one.select(bag, F.inline(F.arrays_zip(F.array(*map(F.lit, by_label)).alias("label"), F.col("pooled"))))
    return each.select(bag, "label", F.posexplode("pooled").alias("i", "value")).withColumn("value", F.round("value", digits))


def label_classifier(pooled: DataFrame, bag: str, parameters: DataFrame, bias: dict[str, float], eps: float = 1e-5, digits: int = 6) -> DataFrame:
    """(bag, label, logit): layer normalisation over i, then one linear output for each label.

    ``parameters`` has (label, i, weight, gamma, beta), a row for each label and element: the size of a model's last layer.
    """
    d = pooled.join(F.broadcast(parameters), ["label", "i"])
    wg = F.col("weight") * F.col("gamma")
    one = d.groupBy(bag, "label").agg(F.avg("value").alias("_m"), F.var_pop("value").alias("_v"), F.sum(F.col("value") * wg).alias("_x"), F.sum(wg).alias("_w"), F.sum(F.col("weight") * F.col("beta")).alias("_b"))
    b = F.try_element_at(F.create_map(*[F.lit(x) for k, v in bias.items() for x in (k, float(v))]), F.col("label"))
    logit = (F.col("_x") - F.col("_m") * F.col("_w")) / F.sqrt(F.col("_v") + eps) + F.col("_b") + F.coalesce(b, F.lit(0.0))
    return one.select(bag, "label", F.round(logit, digits).alias("logit"))


#: Own poolings by name: functions of (df, bag, embedding, ...).
OWN: dict = {}


def register_pooling(kind: str, start: Callable, add: Callable, finish: Callable, kept: str) -> None:
    """A user's pooling from three functions of numpy arrays.

    ``start`` makes a state (a vector) of a matrix of rows, ``add`` one of two states, ``finish`` the result (of Spark
    type ``kept``, say ``array<double>``) of a state. States are merged in any order, so ``add`` must not depend on it;
    that is tried on a small matrix here, and a function that does is refused.
    """
    import numpy as np

    rows = np.arange(24.0).reshape(6, 4) % 7
    whole, split, turned = start(rows), add(start(rows[:2]), start(rows[2:])), add(start(rows[2:]), start(rows[:2]))
    if not (np.allclose(whole, split) and np.allclose(whole, turned)):
        raise ValueError(f"states of pooling {kind} don't merge")
    if kind in KNOWN or kind in OWN:
        raise ValueError(f"pooling {kind} is there already")

    def pool(df: DataFrame, bag: str, embedding: str) -> DataFrame:
        key = df.schema[bag].dataType.simpleString()
        schema = f"bag {key}, salt int, state array<double>"

        def of_batch(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            salt = TaskContext.get().partitionId() % bags.SALTS
            for batch in batches:
                if len(batch):
                    coded = batch.columns[0].dictionary_encode(null_encoding="encode")
                    codes, h = coded.indices.to_numpy(zero_copy_only=False), bags.rows_of(batch.columns[1])
                    kinds = np.unique(codes)
                    states = [np.asarray(start(h[codes == k]), dtype=float).tolist() for k in kinds]
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(kinds)), pa.array([salt] * len(kinds), type=pa.int32()), pa.array(states, type=pa.list_(pa.float64()))], names=["bag", "salt", "state"])

        def merge(batches):
            import pyarrow as pa

            at, kind_, state = None, None, None
            made = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], type=kind_), pa.array([at[1]], type=pa.int32()), pa.array([np.asarray(state, dtype=float).tolist()], type=pa.list_(pa.float64()))], names=["bag", "salt", "state"])
            for batch in batches:
                for bag_, salt, own in zip(*(c.to_pylist() for c in batch.columns)):
                    if at == (bag_, salt):
                        state = add(state, np.array(own))
                    else:
                        if at is not None:
                            yield made()
                        at, kind_, state = (bag_, salt), batch.columns[0].type, np.array(own)
            if at is not None:
                yield made()

        @F.arrow_udf(kept)
        def last(column):
            import pyarrow as pa

            return pa.array([np.asarray(finish(np.array(s.as_py()))).tolist() for s in column])

        d = df.select(F.col(bag).alias("bag"), F.col(embedding).cast("array<double>").alias("h")).where("h is not null").mapInArrow(of_batch, schema)
        for salt in (F.col("salt"), F.lit(0)):
            d = d.withColumn("salt", salt).repartition("bag", "salt").sortWithinPartitions("bag", "salt").mapInArrow(merge, schema)
        return d.select(F.col("bag").alias(bag), last(F.col("state")).alias("pooled"))

    OWN[kind] = pool


KNOWN = {"mean": mean_pool, "masked_mean": masked_mean, "attention": attention_pool, "label_attention": label_attention_pool, "multihead": bags.multihead_pool}


def pooling_of(kind: str):
    """The pooling by name, built in or registered; an unknown one raises."""
    known = KNOWN | OWN
    if kind not in known:
        raise ValueError(f"unknown pooling: {kind}; known: {', '.join(known)}")
    return known[kind]
