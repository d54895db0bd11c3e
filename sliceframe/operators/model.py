"""A model over bags of embeddings as a table of layers, and its scores in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceframe.functions.scalar import sigmoid
from sliceframe.operators import bags

TABLE = "pooling string, labels array<string>, heads int, temperature double, layer string, shape array<int>, values array<double>"
#: Poolings by name, and the layers that each needs (fixed values; K layers stand for one a label).
POOLINGS = {
    "mean": ("norm.weight", "norm.bias", "classifier.weight", "classifier.bias"),
    "attention": ("norm.weight", "norm.bias", "classifier.weight", "classifier.bias", "query", "in_proj_weight", "in_proj_bias", "out_proj.weight", "out_proj.bias"),
    "label_specific_attention": ("attention_projection.weight", "attention_projection.bias", "query_vectors", "layer_norms.weight", "layer_norms.bias", "classifiers.weight", "classifiers.bias"),
}
EPSILON = 1e-5


@dataclass
class Model:
    """Layers by name as numpy arrays; ``planes`` (rows that are added to embeddings by plane) is optional."""

    pooling: str
    labels: list[str]
    layers: dict
    heads: int = 4
    temperature: float = 1.0

    def __post_init__(self):
        if self.pooling not in POOLINGS:
            raise ValueError(f"unknown pooling: {self.pooling}; known: {', '.join(POOLINGS)}")
        if missing := [k for k in POOLINGS[self.pooling] if k not in self.layers]:
            raise ValueError(f"layers are missing: {', '.join(missing)}")

    def n_parameters(self) -> int:
        return sum(v.size for v in self.layers.values())


def save(spark: SparkSession, model: Model, path: str) -> None:
    rows = [(model.pooling, model.labels, model.heads, model.temperature, k, list(v.shape), v.ravel().astype(float).tolist()) for k, v in model.layers.items()]
    spark.createDataFrame(rows, TABLE).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """The model that ``save`` wrote. Layers are a model's size, not the data's."""
    import numpy as np

    rows = spark.read.schema(TABLE).parquet(path).collect()
    if not rows:
        raise ValueError(f"no layers in {path}")
    one = rows[0]
    return Model(one.pooling, list(one.labels), {r.layer: np.array(r["values"]).reshape(r.shape) for r in rows}, one.heads, one.temperature)


@dataclass
class Scored:
    """Lazy outputs of one plan: logits (bag, label, score, probability), studies (bag, n, pooled), attention (rows with an array in the order of labels) or None."""

    logits: DataFrame
    studies: DataFrame
    attention: DataFrame | None


def normed(x, weight, bias):
    import numpy as np

    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + EPSILON) * weight + bias


def head(model: Model):
    """Pooled arrays (one for all labels, or one for each) to logits in the order of labels."""
    layers, by_label = model.layers, model.pooling == "label_specific_attention"

    @F.arrow_udf("array<double>")
    def apply(column):
        import numpy as np
        import pyarrow as pa

        x = bags.rows_of(column.flatten()).reshape(len(column), len(model.labels) if by_label else 1, -1)
        if by_label:
            out = np.einsum("nkd,kd->nk", normed(x, layers["layer_norms.weight"], layers["layer_norms.bias"]), layers["classifiers.weight"]) + layers["classifiers.bias"]
        else:
            out = normed(x[:, 0], layers["norm.weight"], layers["norm.bias"]) @ layers["classifier.weight"].T + layers["classifier.bias"]
        return pa.array(out.tolist(), type=pa.list_(pa.float64()))

    return apply.asNondeterministic()


def label_scores(model: Model):
    """(embedding, plane index) to one attention score a label."""
    layers = model.layers

    @F.arrow_udf("array<double>")
    def apply(column, plane):
        import numpy as np

        x = bags.rows_of(column, layers["attention_projection.weight"].shape[1])
        if "planes" in layers:
            x = x + layers["planes"][plane.fill_null(0).to_numpy()]
        z = np.tanh(x @ layers["attention_projection.weight"].T + layers["attention_projection.bias"])
        return bags.vectors(z @ layers["query_vectors"].T / model.temperature, column)

    return apply


def score(df: DataFrame, bag: str, embedding: str, model: Model, *, mask: Column | None = None, plane: Column | None = None) -> Scored:
    """Embeddings to probabilities. ``mask`` holds the valid rows; ``plane`` is an index into the model's plane rows.

    A bag without a valid row has zeros as its mean, and no row where attention pools it. Columns of ``df`` stay in the attention.
    """
    h, valid = F.col(embedding), F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    attention = None
    if model.pooling == "mean":
        # Equal scores are equal weights; the total is how many there are.
        state = bags.accumulate(df, bag, h, F.array(F.when(valid, F.lit(0.0))))
        n = F.element_at("total", 1)
        studies = state.select(bag, n.cast("long").alias("n"), F.array(F.transform("sums", lambda x: x / F.greatest(n, F.lit(1.0)))).alias("pooled"))
    elif model.pooling == "attention":
        got = bags.multihead_pool(df, bag, embedding, model.layers, model.heads, valid)
        studies = got.select(bag, "n", F.array("pooled").alias("pooled"))
    else:
        index = F.lit(0) if plane is None else plane.cast("int")
        on = df.where(valid)
        scores = label_scores(model)(h, index)
        state = bags.accumulate(on, bag, h, scores)
        studies = bags.pooled(state, bag, len(model.labels))
        attention = bags.weights(on, bag, scores, state)
    rows = F.arrays_zip(F.array(*map(F.lit, model.labels)).alias("label"), head(model)(F.col("pooled")).alias("score"))
    logits = studies.select(bag, F.inline(rows)).withColumn("probability", sigmoid(F.col("score")))
    return Scored(logits, studies, attention)
