"""Counts of label against prediction, and the cluster agreement measures built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` for the combinations that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame, predictions: list) -> DataFrame:
    """One row per label, one column per listed prediction."""
    return cells.groupBy("label").pivot("prediction", predictions).agg(F.sum("n")).na.fill(0)


def _pairs(n: Column) -> Column:
    return n * (n - 1.0) / 2.0


def agreement(cells: DataFrame) -> DataFrame:
    """One row: n, purity, rand and adjusted rand index, as percentages.

    One cube over the counted cells gives cell, label, cluster and grand totals together.
    """
    totals = cells.cube("label", "prediction").agg(
        F.sum("n").cast("double").alias("n"), F.max("n").alias("top"), F.grouping_id().alias("level")
    )

    def total(level: int, value: Column) -> Column:
        return F.sum(F.when(F.col("level") == level, value))

    n = F.col("n")
    sums = totals.agg(
        total(3, n).alias("n"),
        total(0, _pairs(n)).alias("cells"),
        total(1, _pairs(n)).alias("labels"),
        total(2, _pairs(n)).alias("clusters"),
        total(2, F.col("top").cast("double")).alias("top"),
    )
    every = _pairs(F.col("n"))
    expected = F.col("labels") * F.col("clusters") / every
    most = (F.col("labels") + F.col("clusters")) / 2.0
    # With fewer than two rows, or one block on both sides, any two groupings agree fully.
    rand = F.when(every > 0, (every + 2.0 * F.col("cells") - F.col("labels") - F.col("clusters")) / every).otherwise(1.0)
    adjusted = F.when((every > 0) & (F.when(every > 0, most - expected) != 0), (F.col("cells") - expected) / (most - expected))
    return sums.select(
        F.col("n").cast("long").alias("n"),
        (F.col("top") / F.col("n") * 100).alias("purity"),
        (rand * 100).alias("ri"),
        (F.coalesce(adjusted, F.lit(1.0)) * 100).alias("ari"),
    )
