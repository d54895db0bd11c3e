"""Class weights, losses and ranking metrics on (label, y, score) rows; a null y is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.functions.scalar import clip, safe_ratio, sigmoid
from sliceframe.operators.ranks import bucket


def class_weights(long: DataFrame, method: str = "balanced", lo: float = 0.1, hi: float = 10.0, beta: float = 0.9999, digits: int = 6) -> DataFrame:
    if method not in ("balanced", "effective_num"):
        raise ValueError(f"unknown weight method: {method}")
    n = long.groupBy("label").agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    if method == "balanced":
        raw = F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(safe_ratio(F.col("neg"), F.col("pos")))
    else:
        each = (1 - beta) / F.greatest(1 - F.pow(F.lit(beta), F.col("pos").cast("double")), F.lit(1e-8))
        n = n.withColumn("_raw", each)
        all_ = Window.partitionBy(F.lit(1))
        raw = F.col("_raw") / F.avg("_raw").over(all_) * F.count("*").over(all_)
    return n.select("label", F.round(clip(raw, F.lit(lo), F.lit(hi)), digits).alias("weight"))


def bce_with_logits(x: Column, y: Column, weight: Column) -> Column:
    return (1 - y) * x + (1 + (weight - 1) * y) * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def bce_loss(preds: DataFrame, weights: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Mean over labelled cells, 0 if there are none. ``weights`` has a row a label."""
    d = preds.where("y is not null")
    d = d.withColumn("weight", F.lit(1.0)) if weights is None else d.join(weights, "label")
    return d.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(bce_with_logits(F.col("score"), F.col("y"), F.col("weight"))), F.lit(0.0)), digits).alias("loss"))


def by_score(preds: DataFrame) -> DataFrame:
    """(label, score, p, n): positives and negatives of each distinct score, so windows see scores and not rows."""
    return preds.where("y is not null").groupBy("label", "score").agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") == 0).alias("n"))


def roc_auc(preds: DataFrame, digits: int = 6) -> DataFrame:
    """Probability that a positive outranks a negative, ties half; null with a single class."""
    prior = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    d = by_score(preds).withColumn("_b", bucket(F.col("score")))
    d = d.withColumn("_below", F.coalesce(F.sum("n").over(prior("label", "_b").orderBy("score")), F.lit(0)))
    d = d.groupBy("label", "_b").agg(F.sum(F.col("p") * (F.col("_below") + F.col("n") / F.lit(2.0))).alias("_won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    d = d.withColumn("_below", F.coalesce(F.sum("n").over(prior("label").orderBy("_b")), F.lit(0)))
    won = F.sum(F.col("_won") + F.col("p") * F.col("_below"))
    return d.groupBy("label").agg(F.round(F.try_divide(won, F.sum("p").cast("double") * F.sum("n").cast("double")), digits).alias("roc_auc"))


def average_precision(preds: DataFrame, digits: int = 6) -> DataFrame:
    """Sum of precision times gain in recall over distinct scores, from high to low."""
    d = by_score(preds).withColumn("_b", bucket(F.col("score")))
    per = d.groupBy("label", "_b").agg(F.sum("p").alias("_tp0"), F.sum(F.col("p") + F.col("n")).alias("_all0"))
    above = Window.partitionBy("label").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({k: F.coalesce(F.sum(k).over(above), F.lit(0)) for k in ("_tp0", "_all0")})
    w = Window.partitionBy("label", "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(per, ["label", "_b"]).withColumn("_tp", F.col("_tp0") + F.sum("p").over(w)).withColumn("_all", F.col("_all0") + F.sum(F.col("p") + F.col("n")).over(w))
    ap = F.try_divide(F.sum(F.col("p") * F.col("_tp") / F.col("_all").cast("double")), F.sum("p").cast("double"))
    return d.groupBy("label").agg(F.round(F.when(F.sum("n") > 0, ap), digits).alias("pr_auc"))


def macro(aucs: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return aucs.agg(F.round(F.coalesce(F.avg(column), F.lit(0.0)), digits).alias(f"macro_{column}"), F.count(column).alias("n_valid"))


def metric_bundle(preds: DataFrame, digits: int = 6) -> DataFrame:
    """A row a label with both areas, whether it is valid (two classes), and both macro means over valid labels (0 if there are none)."""
    each = roc_auc(preds, digits).join(average_precision(preds, digits), "label")
    w = Window.partitionBy(F.lit(1))
    mean = lambda c: F.round(F.coalesce(F.avg(c).over(w), F.lit(0.0)), digits)
    return each.select("label", "roc_auc", "pr_auc", F.col("roc_auc").isNotNull().alias("valid"), mean("roc_auc").alias("macro_roc_auc"), mean("pr_auc").alias("macro_pr_auc"))


def loss_for(train: DataFrame, preds: DataFrame, method: str = "balanced", digits: int = 6) -> DataFrame:
    """The weighted loss of ``preds`` with class weights taken from the training labels."""
    return bce_loss(preds, F.broadcast(class_weights(train, method)), digits)


def inference(logits: DataFrame, unit: str, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """(unit, label, score) to a row a unit: maps from label to probability and to decision."""
    p = F.round(sigmoid(F.col("score")), digits)
    pairs = F.array_sort(F.collect_list(F.struct("label", p.alias("prob"), (sigmoid(F.col("score")) >= threshold).cast("int").alias("decision"))))
    d = logits.groupBy(unit).agg(pairs.alias("_p"))
    return d.select(unit, F.map_from_arrays("_p.label", "_p.prob").alias("probabilities"), F.map_from_arrays("_p.label", "_p.decision").alias("decisions"))
