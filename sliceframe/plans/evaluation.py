"""Evaluation of a model's scores: predictions are written once, and loss, areas and decisions read them."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceframe.operators import metrics


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where none is set and all runs in this process, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='ckpt')}/predictions-{uuid.uuid4().hex}"


@dataclass
class Evaluation:
    """``predictions`` is (unit, label, score, y); the others are read from it."""

    predictions: DataFrame
    unit: str
    loss: DataFrame
    metrics: DataFrame

    def decisions(self, threshold: float = 0.5) -> DataFrame:
        return metrics.inference(self.predictions, self.unit, threshold)


def evaluate(logits: DataFrame, truth: DataFrame, unit: str, *, weights: DataFrame | None = None, dest: str | None = None, digits: int = 6) -> Evaluation:
    """(unit, label, score) against (unit, label, y). Units without truth keep their predictions; null or missing truth counts in no figure.

    With the loss' mean over no cell it is 0; an area is null where a label has a single class.
    """
    spark = logits.sparkSession
    dest = dest or shared_folder(spark)
    logits.select(unit, "label", "score").join(truth.select(unit, "label", "y"), [unit, "label"], "left").write.mode("overwrite").parquet(dest)
    done = spark.read.parquet(dest)
    return Evaluation(done, unit, metrics.bce_loss(done, weights, digits), metrics.metric_bundle(done, digits))
