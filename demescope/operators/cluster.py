"""Clustering of samples in component space.

Input ``(sample_id, region, features)``, output the same plus ``prediction``; models are returned
next to the labelled rows so that new samples can be assigned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demescope.operators.balls import choose_pivots
from demescope.operators.contingency import agreement, confusion
from demescope.operators.distance import as_points
from demescope.operators.reshape import best_by, hash_share
from demescope.session import fit_table, held

#: Leaves that Ward merging starts from; they and their distances are on the driver.
LEAVES = 512
OUTPUT = ["sample_id", "region", "features", "label", "prediction"]


def _fit(df: DataFrame, estimator, standardise: bool = False) -> tuple[DataFrame, PipelineModel]:
    """Label index, optional scaling and the clusterer as one pipeline."""
    stages = [StringIndexer(inputCol="region", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc")]
    if standardise:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_scaled"))
        estimator = estimator.copy({estimator.featuresCol: "_scaled"})
    with fit_table(df) as rows:
        model = Pipeline(stages=[*stages, estimator]).fit(rows)
    return assign(model, df), model


def assign(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Clusters of given samples."""
    return model.transform(df).select(*OUTPUT)


def kmeans(
    df: DataFrame,
    k: int,
    seed: int = 1234,
    max_iter: int = 20,
    init_mode: str = "k-means||",
    standardise: bool = False,
) -> tuple[DataFrame, PipelineModel]:
    return _fit(df, KMeans(k=k, seed=seed, maxIter=max_iter, initMode=init_mode), standardise)


def gaussian_mixture(df: DataFrame, k: int, seed: int = 1234, max_iter: int = 10) -> tuple[DataFrame, PipelineModel]:
    """Expectation-maximisation with a full covariance per component."""
    return _fit(df, GaussianMixture(k=k, seed=seed, maxIter=max_iter))


def bisecting_kmeans(df: DataFrame, k: int, seed: int = 1234, max_iter: int = 10) -> tuple[DataFrame, PipelineModel]:
    return _fit(df, BisectingKMeans(k=k, seed=seed, maxIter=max_iter))


ALGORITHMS: dict[str, Callable[..., tuple[DataFrame, PipelineModel]]] = {
    "kmeans": kmeans,
    "gmm": gaussian_mixture,
    "bkm": bisecting_kmeans,
}


def tune_k(
    df: DataFrame,
    algorithm: str = "kmeans",
    ks: Sequence[int] = (2, 3, 4, 5),
    repeats: int = 1,
    train_share: float = 0.7,
    seed: int = 1234,
) -> DataFrame:
    """``(k, repeat, purity, ari)`` on the validation rows of each repeat's own split.

    Purity cannot fall as k grows, hence the adjusted index beside it.
    """
    fit = ALGORITHMS[algorithm]
    scores = []
    with held(df) as rows:
        for repeat in range(repeats):
            u = hash_share("sample_id", seed + repeat)
            train, judged = rows.filter(u < train_share), rows.filter(u >= train_share)
            for k in ks:
                _, model = fit(train, k, seed=seed + repeat)
                row = agreement(confusion(assign(model, judged), "region", "prediction")).first()
                scores.append((k, repeat, row["purity"], row["ari"]))
    return df.sparkSession.createDataFrame(scores, "k int, repeat int, purity double, ari double")


def best_k(scores: DataFrame, measure: str = "purity") -> DataFrame:
    """The k with the best mean over repeats; the smaller k on equal scores."""
    means = scores.groupBy("k").agg(F.avg("purity").alias("purity"), F.avg("ari").alias("ari"))
    return best_by(means, measure, ["k"])


# --- nearest of a few centres --------------------------------------------------------------


def nearest_centre(df: DataFrame, centres: np.ndarray, out: str = "prediction", relabel: np.ndarray | None = None) -> DataFrame:
    """Adds the number of the nearest centre (or its new label); ``centres`` is a model-sized matrix."""
    centres = np.asarray(centres, dtype=float)
    names = np.arange(len(centres)) if relabel is None else np.asarray(relabel)

    @F.pandas_udf(T.IntegerType())
    def nearest(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype="int32")
        x = np.stack(values.to_numpy())
        found = np.empty(len(x), dtype=np.int64)
        step = max(1, 4_000_000 // max(1, centres.size))
        for s in range(0, len(x), step):
            d = x[s : s + step, None, :] - centres[None]
            found[s : s + step] = np.einsum("ijk,ijk->ij", d, d).argmin(axis=1)
        return pd.Series(names[found].astype("int32"))

    return df.withColumn(out, nearest(vector_to_array("features")))


# --- hierarchical --------------------------------------------------------------------------


def ward_labels(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative merging of a few hundred weighted points by Ward's update, cut at ``k``.

    Dissimilarities start as plain (unsquared) distances. Groups are numbered by their first member.
    """
    n = len(points)
    size = weights.astype(float)
    gap = points[:, None, :] - points[None]
    d = np.sqrt((gap**2).sum(axis=2)) * (2 * size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    group = np.arange(n)
    alive = np.ones(n, dtype=bool)
    for _ in range(n - min(k, n)):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        total = size[i] + size[j] + size
        merged = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        merged[[i, j]] = np.inf
        merged[~alive] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        group[group == j] = i
    first = {g: p for p, g in reversed(list(enumerate(group)))}
    order = {g: r for r, g in enumerate(sorted(first, key=first.get))}
    return np.array([order[g] for g in group])


def ward(df: DataFrame, k: int, leaves: int = LEAVES, max_iter: int = 10) -> DataFrame:
    """Ward clusters of any number of samples, by one method at every size.

    ``leaves`` samples, those of the smallest hashes of their ids, start the leaves; a few distributed k-means steps
    move them to the means of the samples nearest to them. The leaves, weighted by their sizes, are merged, and every
    sample takes the cluster of its nearest leaf. A cohort of no more samples than leaves has each as a leaf of its
    own, which no step moves: the textbook method.
    """
    points = as_points(df, "sample_id", "features")
    centres, sizes = lloyd(df, choose_pivots(points, 1, leaves), max_iter)
    centres, sizes = centres[sizes > 0], sizes[sizes > 0]
    order = np.lexsort(centres.T[::-1])  # groups are numbered by their first leaf
    return nearest_centre(df, centres[order], relabel=ward_labels(centres[order], sizes[order], k))


def cluster_centres(predictions: DataFrame) -> np.ndarray:
    """Mean feature vector per cluster, by cluster number."""
    from demescope.operators.cluster_metrics import centroids

    rows = centroids(as_points(predictions, "sample_id", "features", cluster="prediction")).orderBy("cluster").collect()
    return np.array([r["centre"] for r in rows])


def lloyd(df: DataFrame, centres: np.ndarray, max_iter: int, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """K-means steps from given centres: the centres and how many rows were nearest to each in the last step.

    Each step adds up a sum per centre and task and moves only those.
    """
    centres = np.array(centres, dtype=float)
    sizes = np.zeros(len(centres))
    with held(df.select(vector_to_array("features").alias("x"))) as rows:
        for _ in range(max_iter):
            now = centres.copy()

            def sums(batches):
                total, size = np.zeros_like(now), np.zeros(len(now))
                for pdf in batches:
                    if not len(pdf):
                        continue
                    x = np.stack(pdf["x"].to_numpy())
                    step = max(1, 4_000_000 // max(1, now.size))
                    for s in range(0, len(x), step):
                        part = x[s : s + step]
                        gap = part[:, None, :] - now[None]
                        c = np.einsum("ijk,ijk->ij", gap, gap).argmin(axis=1)
                        np.add.at(total, c, part)
                        np.add.at(size, c, 1)
                yield pd.DataFrame({"c": np.arange(len(now)), "n": size, "s": list(total)})

            entry = F.posexplode("s").alias("i", "v")
            parts = rows.mapInPandas(sums, "c int, n double, s array<double>")
            totals = parts.select("c", "n", entry).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
            for r in totals:
                sizes[r["c"]] = r["n"]
                if r["n"] > 0:
                    centres[r["c"], r["i"]] = r["v"] / r["n"]
            if not len(centres) or np.abs(centres - now).max() <= tol:
                break
    return centres, sizes


def seeded_kmeans(df: DataFrame, centres: np.ndarray, max_iter: int = 20, tol: float = 1e-9) -> DataFrame:
    """K-means from given centres."""
    return nearest_centre(df, lloyd(df, centres, max_iter, tol)[0])


def ward_kmeans(df: DataFrame, k: int, leaves: int = LEAVES) -> DataFrame:
    """K-means started from the centroids of the Ward clusters."""
    return seeded_kmeans(df, cluster_centres(ward(df, k, leaves)))


def em_clusters(df: DataFrame, k: int, seed: int = 1234, max_iter: int = 100) -> DataFrame:
    """Gaussian mixture clusters run to convergence."""
    return gaussian_mixture(df, k, seed, max_iter)[0].select("sample_id", "region", "features", "prediction")


TUNED = {"hierarchical": ward, "kmeans": ward_kmeans, "em": em_clusters}


def cluster_members(predictions: DataFrame, cluster: int, regions: DataFrame) -> DataFrame:
    """Samples of one cluster with labels of another level, ready to be analysed again."""
    members = predictions.filter(F.col("prediction") == cluster).select("sample_id")
    return regions.join(members, "sample_id", "left_semi")
