"""Distances between two numeric arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "minkowski", "hamming")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def minkowski(a: Column | str, b: Column | str, p: float) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p))))
    return F.pow(_sum(parts), F.lit(1.0 / p))


def euclidean(a: Column | str, b: Column | str) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_sum(F.transform(gap, lambda d: d * d)))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of entries that differ."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def vector_distance(a: Column | str, b: Column | str, metric: str = "euclidean", p: float = 2) -> Column:
    if metric == "minkowski":
        return minkowski(a, b, p)
    if metric in METRICS:
        return {"euclidean": euclidean, "manhattan": manhattan, "hamming": hamming}[metric](a, b)
    raise ValueError(f"metric must be one of {METRICS}")
