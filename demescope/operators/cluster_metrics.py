"""Quality of a clustering: agreement with labels, and separation in feature space."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.operators.contingency import agreement, confusion
from demescope.operators.distance import as_points, cluster_separation

METRIC_COLUMNS = ("purity", "ri", "ari", "ch", "dunn")


def _moments(points: DataFrame) -> DataFrame:
    """Size, mean and within sum of squares of each cluster, by mergeable vector summaries."""
    v = array_to_vector("features")
    s = points.groupBy("cluster").agg(
        F.count("*").alias("n"), Summarizer.mean(v).alias("mean"), Summarizer.variance(v).alias("var")
    )
    spread = F.aggregate(vector_to_array("var"), F.lit(0.0), lambda a, x: a + x) * (F.col("n") - 1)
    return s.select("cluster", "n", vector_to_array("mean").alias("centre"), spread.alias("within"))


def centroids(points: DataFrame) -> DataFrame:
    """``(cluster, n, centre)``: the mean of each cluster's feature arrays."""
    return _moments(points).select("cluster", "n", "centre")


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row ``ch``: between over within variance, each per degree of freedom."""
    m = _moments(points)
    entries = m.select("cluster", "n", "within", F.posexplode("centre").alias("i", "x"))
    by_entry = entries.groupBy("i").agg(
        F.sum(F.col("n") * F.col("x")).alias("sx"),
        F.sum(F.col("n") * F.col("x") * F.col("x")).alias("sxx"),
        F.sum("n").alias("n"),
    )
    between = by_entry.agg(F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("b")).scalar()
    sums = m.agg(F.sum("within").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ratio = (between / (F.col("k") - 1.0)) / (F.col("w") / (F.col("n") - F.col("k")))
    defined = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("w") > 0)
    return sums.select(F.when(defined, ratio).alias("ch"))


def dunn(points: DataFrame) -> DataFrame:
    """One row ``dunn``: smallest distance between clusters over the largest within one."""
    return cluster_separation(points).select(
        F.when(F.col("max_within") > 0, F.col("min_between") / F.col("max_within")).alias("dunn")
    )


def cluster_metrics(predictions: DataFrame, digits: int = 2) -> DataFrame:
    """One row of all measures from ``(sample_id, region, features, prediction)``."""
    points = as_points(predictions, "sample_id", "features", cluster="prediction")
    row = agreement(confusion(predictions, "region", "prediction"))
    row = row.withColumn("ch", calinski_harabasz(points).scalar()).withColumn("dunn", dunn(points).scalar())
    return row.select("n", *[F.round(c, digits).alias(c) for c in METRIC_COLUMNS])


def summary_table(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row per algorithm from named one-row metric tables."""
    out = None
    for name, row in metrics.items():
        named = row.select(F.lit(name).alias("algorithm"), *METRIC_COLUMNS)
        out = named if out is None else out.unionByName(named)
    return out
