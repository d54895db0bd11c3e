"""Geometry on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = {0: "sagittal", 1: "coronal", 2: "axial"}


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def bound(value: Column, body) -> Column:
    """Evaluates ``value`` once a row for ``body``: repeated in generated code, it would make methods too long to be compiled."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column, least: float = 1e-8) -> Column:
    length = lambda v: F.sqrt(dot(v, v))
    return bound(v, lambda v: bound(length(v), lambda n: F.when(n >= least, F.transform(v, lambda x: x / n))))


def slice_normal(iop: Column) -> Column:
    """Normalised cross product of row and column directions; null if short or degenerate."""

    def product(v: Column) -> Column:
        g = [F.get(v, F.lit(i)).cast("double") for i in range(6)]
        return F.when(F.size(v) >= 6, F.array(*cross(g[:3], g[3:])))

    return unit(bound(iop, product))


def dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(1, 3)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def plane_of(normal: Column, min_alignment: float = 0.8, min_separation: float = 0.2) -> Column:
    """Dominant axis of a normal, if it is aligned enough and stands apart from the second; else unknown."""
    a = F.transform(normal, lambda x: F.abs(x))
    top = F.sort_array(a, asc=False)
    best, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    at = F.array_position(a, best)
    name = F.when(at == 1, AXES[0]).when(at == 2, AXES[1]).otherwise(AXES[2])
    return F.when((best >= min_alignment) & (best - second >= min_separation), name).otherwise("unknown")
