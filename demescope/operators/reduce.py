"""Dimensionality reduction: PCA of feature vectors, PCA of genotypes, classical scaling.

PCA goes through ``subspace.leading``, one method at every number of samples and features, unless a caller names
another of ``factorise.METHODS``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demescope.operators import factorise, subspace
from demescope.operators.distance import ListedDistances, SampleDistances
from demescope.operators.qc import enough_calls, label_regions
from demescope.operators.reshape import dense_index, number_rows, slice_vector, split_rows
from demescope.session import cut_lineage

PCA_METHODS = factorise.METHODS
#: Columns of a block and of all blocks in a scaling, and products after which it is given up.
MDS_BLOCK, MDS_BASIS, MDS_PRODUCTS = 64, 320, 300


# --- choosing the number of components ----------------------------------------------------


def components_by_share(values, threshold: float) -> int:
    """Leading values whose running share stays within the threshold; at least one."""
    values = np.asarray(values, dtype=float)
    running = np.cumsum(values / values.sum())
    return max(1, int((running <= threshold).sum()))


def _row_matrix(df: DataFrame, vector: str) -> RowMatrix:
    """A distributed matrix straight from a vector column; rows never pass through Python."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(vector), vector))


def explained_components(df: DataFrame, threshold: float = 0.7, vector: str = "features") -> int:
    """Components to keep by the singular values of uncentred score vectors.

    The products of the score columns are summed in one pass; that matrix is as wide as a score vector.
    """
    squares = np.linalg.eigvalsh(_row_matrix(df, vector).computeGramianMatrix().toArray())[::-1]
    return components_by_share(np.sqrt(np.maximum(squares, 0.0)), threshold)


# --- PCA of feature vectors ---------------------------------------------------------------


@dataclass
class Components:
    """A fitted PCA: singular values of the centred (scaled) matrix, loadings ``(fb, m)`` and the columns' scale."""

    values: np.ndarray
    loadings: DataFrame
    scale: DataFrame

    @property
    def k(self) -> int:
        return len(self.values)

    def project(self, df: DataFrame, vector: str = "features") -> DataFrame:
        """The vector replaced by its uncentred scores: scaled entries times the loadings."""
        k = self.k
        rows = number_rows(df, "_row")
        parts = subspace.vector_blocks(rows.select("_row", vector_to_array(vector).alias("v")), "_row", "v")
        scale = subspace.vector_blocks(self.scale.select(F.lit(0).alias("at"), "scale"), "at", "scale").select("fb", F.col("part").alias("scale"))

        def dot(frames):
            for pdf in frames:
                out = [(np.asarray(r.part) * r.scale) @ subspace.unpack(r.m, k) for r in pdf.itertuples()]
                yield pd.DataFrame({"_row": pdf["_row"], "f": out})

        dots = parts.join(scale, "fb").join(self.loadings, "fb").mapInPandas(dot, "_row long, f array<double>")
        sums = dots.groupBy("_row").agg(Summarizer.sum(array_to_vector("f")).alias("_scores"))
        return rows.drop(vector).join(sums, "_row").drop("_row").withColumnRenamed("_scores", vector)


def fit_components(
    df: DataFrame, k: int, vector: str = "features", scaled: bool = False, method: str = "GramSVD", seed: int = 1234
) -> tuple[Components, DataFrame]:
    """PCA of vectors of any length, and ``(_row, f)`` uncentred scores with the numbered rows they belong to.

    ``scaled`` divides columns by their deviation; a column without any counts as 0.
    """
    rows = number_rows(df, "_row")
    arrays = rows.select(F.col("_row").alias("sample_no"), vector_to_array(vector).alias("features"))
    n, width = arrays.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n or not width:
        raise ValueError("no vector to decompose")
    v = array_to_vector("features")
    stats = arrays.agg(Summarizer.mean(v).alias("mean"), Summarizer.std(v).alias("std"))
    scale = F.transform(vector_to_array("std"), lambda d: F.when(d > 0, 1 / d).otherwise(F.lit(0.0)) if scaled else F.lit(1.0))
    about = cut_lineage(stats.select(vector_to_array("mean").alias("mean"), scale.alias("scale")))
    tiles = subspace.vector_tiles(arrays, n, about, width)
    found = factorise.decomposed(tiles, k, method, seed)
    turn = subspace.signed(found)
    loads = cut_lineage(subspace.loadings(tiles, found))
    shift = subspace.feature_sums(tiles, loads, found.width) * turn
    w = found.width
    signed_loads = subspace.mapped(loads, "fb long, m binary", lambda r: [r.fb, subspace.pack(subspace.unpack(r.m, w) * turn)])
    scores = subspace.sample_rows(found, np.diag(found.values * turn))
    shifted = F.transform("f", lambda x, i: x + F.element_at(F.lit(shift.tolist()), i + 1))
    scores = scores.select(F.col("sample_no").alias("_row"), array_to_vector(shifted).alias("_scores"))
    return Components(found.values, signed_loads, about), rows.drop(vector).join(scores, "_row").drop("_row").withColumnRenamed("_scores", vector)


def pca_features(df: DataFrame, k: int, vector: str = "features") -> tuple[DataFrame, Components]:
    """Replaces the vector by its first ``k`` component scores (of the vector as it is, not centred)."""
    model, scores = fit_components(df, k, vector)
    return scores, model


def _cut(scores: DataFrame, values: np.ndarray, threshold: float, mode: str, vector: str = "features") -> DataFrame:
    """Leading components within the explained share.

    ``mode='reference'`` takes shares of singular values of the scores, ``'variance'`` those of the
    eigenvalues of the covariance.
    """
    if mode not in ("reference", "variance"):
        raise ValueError("mode must be 'reference' or 'variance'")
    keep = explained_components(scores, threshold, vector) if mode == "reference" else components_by_share(values**2, threshold)
    return slice_vector(scores, keep, vector)


def pca_scaled(df: DataFrame, k: int, threshold: float = 0.7, mode: str = "reference", vector: str = "features") -> DataFrame:
    """PCA of columns scaled to unit deviation, scores of the scaled columns as they are, cut by explained share."""
    model, scores = fit_components(df, k, vector, scaled=True)
    return _cut(cut_lineage(scores), model.values, threshold, mode, vector)


def pca_on_split(
    df: DataFrame,
    k: int = 0,
    threshold: float = 0.5,
    train_share: float = 0.7,
    method: str = "GramSVD",
    seed: int = 1234,
    vector: str = "features",
) -> DataFrame:
    """PCA fitted on a training split, scores for all rows, cut by explained share.

    ``k = 0`` takes as many components as the data allow. ``method``: subspace iteration (GramSVD), power iteration
    with deflation, a Gaussian sketch or a low-rank fit; see ``factorise``.
    """
    if method not in PCA_METHODS:
        raise ValueError(f"method must be one of {PCA_METHODS}")
    train, _ = split_rows(df, train_share, seed)
    if k == 0:
        p = df.schema[vector].metadata.get("ml_attr", {}).get("num_attrs") or len(df.select(vector).first()[0])
        k = max(1, min(train.count(), p - 1))
    model, _ = fit_components(train, k, vector, method=method, seed=seed)
    return slice_vector(model.project(df, vector), components_by_share(model.values**2, threshold), vector)


# --- PCA of genotypes ---------------------------------------------------------------------


def _features(cells: DataFrame, scale: Column, keep: Column) -> DataFrame:
    """``feature, no, mean, scale`` of the variants of long dosages that pass ``keep``; ``mean``, ``n``, ``spread`` may be used."""
    stats = cells.filter(F.col("dosage").isNotNull()).groupBy(F.col("snp_idx").alias("feature")).agg(
        F.avg("dosage").alias("mean"), F.count("*").alias("n"), (F.var_pop("dosage") * F.count("*")).alias("spread")
    )
    return dense_index(stats.filter(keep).select("feature", "mean", scale.alias("scale")), ["feature"], "no")


def standard_features(cells: DataFrame, n_samples: int, missing_rate: float | None = None) -> DataFrame:
    """Varying variants with the centre and factor of ``(g - 2p) / sqrt(p (1 - p))``; above the missing rate they are left out."""
    p = F.col("mean") / 2
    keep = (p > 0) & (p < 1)
    if missing_rate is not None:
        keep = keep & enough_calls(F.col("n"), F.lit(n_samples), missing_rate)
    return _features(cells, 1 / F.sqrt(p * (1 - p)), keep)


def _long(cells: DataFrame) -> DataFrame:
    return cells.select("sample_no", F.col("snp_idx").alias("feature"), F.col("dosage").alias("value"))


def sample_pca(
    cells: DataFrame,
    k: int = 4,
    missing_rate: float | None = None,
    scaled: bool = False,
    method: str = "GramSVD",
) -> tuple[DataFrame, DataFrame]:
    """PCA of samples from numbered dosages: ``(sample_id, features)`` and the eigenvalues.

    Missing dosages count as the variant's mean; with ``method='GLRM'`` they are left out of the fit. ``scaled`` multiplies unit vectors by the singular values.
    Eigenvalues: ``(pc, eigenvalue, share)``, shares of the total variance.
    """
    samples = cells.select("sample_id", "sample_no").distinct()
    n = samples.agg(F.max("sample_no") + 1).first()[0]
    tiles = subspace.long_tiles(_long(cells), standard_features(cells, n, missing_rate), n)
    if not tiles.n_features:
        raise ValueError("no varying variant left for the decomposition")
    found = factorise.decomposed(tiles, min(k, n - 1), method)
    s = found.values
    scores = subspace.sample_rows(found, np.diag(subspace.signed(found) * (s if scaled else 1.0)))
    total = subspace.total_square(tiles)
    values = pd.DataFrame({"pc": np.arange(1, len(s) + 1), "eigenvalue": s**2 / tiles.n_features, "share": s**2 / total})
    named = samples.join(scores, "sample_no").select("sample_id", array_to_vector("f").alias("features"))
    return named, cells.sparkSession.createDataFrame(values)


def sample_pca_scaled(cells: DataFrame, k: int, threshold: float = 0.7, mode: str = "reference") -> DataFrame:
    """``pca_scaled`` of the samples' vectors straight from numbered dosages: ``(sample_id, features)``.

    The vectors, with missing dosages at the variant's mean, are never made, so variants may be any number.
    """
    called = cells.filter(F.col("dosage").isNotNull())
    samples = called.select("sample_id", "sample_no").distinct()
    n, present = samples.agg(F.max("sample_no") + 1, F.count("*")).first()
    deviation = F.sqrt(F.col("spread") / F.lit(float(max(1, present - 1))))
    tiles = subspace.long_tiles(_long(called), _features(called, 1 / deviation, F.col("spread") > 0), n)
    if not tiles.n_features:
        raise ValueError("no varying variant left for the decomposition")
    found = subspace.leading(tiles, k)
    turn = subspace.signed(found)
    shift = subspace.feature_sums(tiles, subspace.loadings(tiles, found), found.width) * turn
    scores = subspace.sample_rows(found, np.diag(found.values * turn))
    shifted = F.transform("f", lambda x, i: x + F.element_at(F.lit(shift.tolist()), i + 1))
    named = samples.join(scores, "sample_no").select("sample_id", array_to_vector(shifted).alias("features"))
    return _cut(cut_lineage(named), found.values, threshold, mode)


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns flipped so that the entry of largest magnitude is positive."""
    lead = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[lead, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def _score_table(spark: SparkSession, scores: np.ndarray) -> DataFrame:
    """``(sample_no, features)`` from a samples x k matrix (k columns per sample, on the driver as
    any eigenvector solver leaves it)."""
    pdf = pd.DataFrame({"sample_no": np.arange(len(scores)), "f": scores.tolist()})
    table = spark.createDataFrame(pdf, "sample_no bigint, f array<double>")
    return table.select("sample_no", array_to_vector("f").alias("features"))


def eigenvalue_table(values: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Component name, eigenvalue, percentage and running percentage, to two decimals; the first ``max_rows`` or all."""
    running = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        (values if max_rows is None else values.filter(F.col("pc") <= max_rows))
        .withColumn("cum", F.sum("share").over(running))
        .select(
            F.concat(F.lit("PC"), F.col("pc").cast("string")).alias("component"),
            F.round("eigenvalue", 2).alias("eigenvalue"),
            F.round(F.col("share") * 100, 2).alias("pct_variance"),
            F.round(F.col("cum") * 100, 2).alias("cum_pct_variance"),
        )
    )


# --- classical multidimensional scaling ---------------------------------------------------


class _Centred:
    """Squared distances centred by the means of their lines: a line of each sample with distances, a column of each of ``n``.

    Only thin matrices are on the driver, the distances stay where ``times`` finds them.
    """

    def __init__(self, times, n: int, q: np.ndarray):
        self.times = times
        sums, self.there = times(np.concatenate([np.ones((n, 1)), q], axis=1))
        self.mean = sums[:, 0] / n
        self.grand = self.mean.mean()
        self.square = bool(self.there.all())
        self.image = self._product(q, self._shifted(sums[:, 1:], q))  # of the first columns

    def _shifted(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        total = x.sum(axis=0)
        return -0.5 * (y - np.outer(self.mean, total) - self.mean @ x + self.grand * total)

    def lines(self, x: np.ndarray) -> np.ndarray:
        return self._lines(self._shifted(self.times(x)[0], x))

    def _lines(self, y: np.ndarray) -> np.ndarray:
        return np.where(self.there[:, None], y, 0.0)

    def _product(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.square:
            return y
        y = self._lines(y)
        return self._shifted(self.times(y)[0], y)

    def product(self, x: np.ndarray) -> np.ndarray:
        """The matrix times ``x``; if samples are lacking, its transpose times that."""
        return self._product(x, self._shifted(self.times(x)[0], x))


def _lanczos(product, q: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` eigenvalues of largest magnitude, and their vectors, of a symmetric matrix known by its products.

    Blocks of a Krylov space, each made orthogonal to all before, restarted from the best vectors at ``MDS_BASIS`` columns. Done when
    each residual is below ``subspace.TOLERANCE`` of the largest value. ``image`` is the product of the first block ``q``.
    """
    n, b = q.shape
    basis = np.empty((n, min(n, max(MDS_BASIS, 2 * k + 4 * b))))
    basis[:, :b], width, h = q, b, q.T @ image
    for _ in range(MDS_PRODUCTS):
        theta, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-np.abs(theta), kind="stable")
        best = order[:k]
        if width < n:
            v = basis[:, :width]
            rest = image - v @ (v.T @ image)
            rest -= v @ (v.T @ rest)
            q, r = np.linalg.qr(rest)
            gaps = np.linalg.norm(r @ u[-b:, best], axis=0)
        if width >= n or gaps.max() <= subspace.TOLERANCE * abs(theta[best[0]]):
            return theta[best], basis[:, :width] @ u[:, best]
        if width + b > basis.shape[1]:
            some = order[: basis.shape[1] - 2 * b]
            basis[:, : len(some)] = basis[:, :width] @ u[:, some]
            width, h = len(some), np.diag(theta[some])
        v = basis[:, :width]
        q = np.linalg.qr(q - v @ (v.T @ q))[0]  # where the rest is but rounding its directions need not be orthogonal
        image = product(q)
        cross = v.T @ image
        h = np.block([[h, cross], [cross.T, q.T @ image]])
        basis[:, width : width + b] = q
        width += b
    raise ValueError("the scaling did not settle")


def classical_mds(
    distances: DataFrame | SampleDistances,
    n: int,
    k: int = 20,
    threshold: float | None = 0.7,
) -> DataFrame:
    """Coordinates ``(sample_no, features)`` from all pair distances of samples 0..n-1.

    ``distances`` are a table of pairs or ``SampleDistances``, which are counted anew for each product and take no room.
    The squared distances, double-centred by row means, are only multiplied with blocks of ``MDS_BLOCK`` columns, which are on
    the driver like the eigenvectors (``MDS_BASIS`` numbers a sample). Axes with negative eigenvalues are dropped;
    leading ones are kept while the running share stays within the threshold, at least one.
    """
    spark = (distances.tiles if isinstance(distances, SampleDistances) else distances).sparkSession
    squares = distances if isinstance(distances, SampleDistances) else ListedDistances.of(distances)
    k = min(k, n - 1)
    if k < 1:
        raise ValueError("scaling takes two samples at least")
    draw = np.random.default_rng(1234).standard_normal((n, MDS_BLOCK)) if n > 2 * MDS_BASIS else np.eye(n)
    with squares.ready(n) as times:
        q = np.linalg.qr(draw)[0]
        centred = _Centred(times, n, q)
        theta, v = _lanczos(centred.product, q, centred.image, k)
        weights = theta if centred.square else np.einsum("ij,ij->j", v, centred.lines(v))
    s = np.abs(theta) if centred.square else np.sqrt(np.maximum(theta, 0.0))
    positive = [i for i in range(len(s)) if s[i] > 1e-9 * s[0] and weights[i] > 1e-9 * s[0]]
    values = s[positive]
    keep = len(values) if threshold is None else components_by_share(values, threshold)
    scores = fix_signs(v[:, positive[:keep]]) * np.sqrt(values[:keep])
    return _score_table(spark, scores)


def mds_euclidean(df: DataFrame, k: int, vector: str = "features") -> DataFrame:
    """Classical scaling of Euclidean distances without forming them: the component scores."""
    scores, _ = pca_features(df, k, vector)
    return scores


def labelled(scores: DataFrame, regions: DataFrame) -> DataFrame:
    """``(sample_id, region, features)``."""
    return label_regions(scores, regions).select("sample_id", "region", "features")
