"""Quality of a classification, from counts of label against prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def class_report(cells: DataFrame) -> DataFrame:
    """Per label: support, precision, recall and F1 (percent).

    ``ref_precision`` / ``ref_recall`` are the same two numbers under the swapped names some
    reports use. A label never predicted has no precision; its F1 is 0.
    """
    long = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").cast("string").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("prediction").cast("string").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("label").cast("string") == F.col("prediction").cast("string"), F.col("n")).otherwise(0).alias("hit"),
    )
    counts = long.groupBy(F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("hits")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") * 100.0 / F.col("predicted"))
    recall = F.when(F.col("support") > 0, F.col("hits") * 100.0 / F.col("support"))
    f1 = F.col("hits") * 200.0 / (F.col("support") + F.col("predicted"))
    return counts.select(
        "label",
        "support",
        "predicted",
        "hits",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        recall.alias("ref_precision"),
        precision.alias("ref_recall"),
    )


def macro_metrics(cells: DataFrame) -> DataFrame:
    """One row: error, accuracy, macro precision, recall and F1 (percent), Cohen's kappa, weighted F1 error."""
    report = class_report(cells)
    n = F.sum("support")
    chance = F.sum(F.col("support").cast("double") * F.col("predicted"))
    return (
        report.agg(
            n.alias("n"),
            (F.sum("hits") * 100.0 / n).alias("accuracy"),
            F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision"),
            F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall"),
            F.avg("f1").alias("f1"),
            (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
            (chance * 100.0 / n / n).alias("expected"),
        )
        .withColumn("error", 100.0 - F.col("accuracy"))
        .withColumn("f1_error", 100.0 - F.col("weighted_f1"))
        .withColumn("kappa", F.when(F.col("expected") < 100, (F.col("accuracy") - F.col("expected")) / (100.0 - F.col("expected"))))
        .select("n", "error", "accuracy", "precision", "recall", "f1", "f1_error", "kappa")
    )


@F.pandas_udf(T.DoubleType())
def _pairwise_auc(cells: pd.Series) -> pd.Series:
    def one(rows):
        n = np.zeros((max(r["l"] for r in rows) + 1, max(r["p"] for r in rows) + 1))
        for r in rows:
            n[r["l"], r["p"]] += r["n"]
        n = n[n.sum(axis=1) > 0]
        if len(n) < 2:
            return None
        codes = np.arange(n.shape[1])

        def median(counts):
            at = np.cumsum(counts)
            total = at[-1]
            low, high = codes[np.searchsorted(at, (total - 1) // 2 + 1)], codes[np.searchsorted(at, total // 2 + 1)]
            return (low + high) / 2.0

        areas = []
        for i in range(len(n)):
            for j in range(i + 1, len(n)):
                above = n[j].sum() - np.cumsum(n[j])
                area = (n[i] * (above + n[j] / 2.0)).sum() / (n[i].sum() * n[j].sum())
                areas.append(area if median(n[i]) <= median(n[j]) else 1.0 - area)
        return float(np.mean(areas))

    return pd.Series([one(r) for r in cells], dtype="float64")


def multiclass_auc(cells: DataFrame) -> DataFrame:
    """One row ``auc``: mean over label pairs of the area under the curve of the predicted class code.

    ``label`` and ``prediction`` are integer class codes. Each pair is oriented by its medians. The
    counts, at most classes squared, meet in one row.
    """
    packed = cells.agg(
        F.collect_list(F.struct(F.col("label").cast("int").alias("l"), F.col("prediction").cast("int").alias("p"), F.col("n").alias("n"))).alias("c")
    )
    return packed.select(_pairwise_auc("c").alias("auc"))


def mean_metrics(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of all numeric measures over repeats."""
    measures = [f.name for f in metrics.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (*by, "repeat")]
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures])
