"""Candidate scoring and ranking with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def score(components: dict[str, Column], weights: dict[str, float], digits: int = 6) -> Column:
    """Weighted sum of components; a null component or a missing weight adds nothing."""
    total = F.lit(0.0)
    for name, c in components.items():
        total = total + F.coalesce(c, F.lit(0.0)) * F.lit(float(weights.get(name, 0.0)))
    return F.round(total, digits)


def rank_candidates(df: DataFrame, slot: list[str], score_col: str, size: Column, uid: Column, out: str = "rnk") -> DataFrame:
    """Score descending, size descending, id ascending."""
    w = Window.partitionBy(*slot).orderBy(F.desc(score_col), size.desc(), uid.asc())
    return df.withColumn(out, F.row_number().over(w))


def per_slot(df: DataFrame, slots: list[str], matches: Column, slot: str = "slot") -> DataFrame:
    """One row for each candidate and slot it may fill; slots are a fixed, short list."""
    return df.withColumn(slot, F.explode(F.array(*[F.lit(s) for s in slots]))).where(matches)
