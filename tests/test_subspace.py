"""The distributed decomposition against numpy, over several blocks either way."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from demescope.operators import reduce, reshape, subspace


def planted(n, m, seed=0, groups=6):
    """Dosages of groups with their own allele frequencies, a few of them missing (-1)."""
    rng = np.random.default_rng(seed)
    p = np.clip(rng.uniform(0.1, 0.9, m)[None] + rng.normal(0, 0.15, (groups, m)), 0.02, 0.98)
    g = rng.binomial(2, p[np.arange(n) % groups])
    g[rng.random((n, m)) < 0.03] = -1
    return g


def long(spark, g):
    i, j = np.nonzero(g >= 0)
    import pandas as pd

    pdf = pd.DataFrame({"sample_no": i, "snp_idx": 3 * j + 5, "dosage": g[i, j]})
    df = spark.createDataFrame(pdf, "sample_no bigint, snp_idx bigint, dosage int")
    return df.withColumn("sample_id", F.format_string("s%05d", "sample_no"))


def standard(g):
    out = []
    for col in g.T:
        ok = col >= 0
        p = col[ok].mean() / 2
        if 0 < p < 1:
            z = np.zeros(len(col))
            z[ok] = (col[ok] - 2 * p) / np.sqrt(p * (1 - p))
            out.append(z)
    return np.array(out)


@pytest.mark.parametrize("n,m", [(230, 140), (700, 1100), (2100, 300)])
def test_leading_vectors_equal_numpy(spark, monkeypatch, n, m):
    """One tile; two blocks of features; two of samples."""
    monkeypatch.setattr(subspace, "FAN", 2)
    g = planted(n, m)
    z = standard(g)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    scores, values = reduce.sample_pca(long(spark, g), 5)
    got = np.array([list(r["features"]) for r in scores.orderBy("sample_id").collect()])
    assert np.allclose(got, reduce.fix_signs(vt[:5].T), atol=1e-8)
    rows = values.orderBy("pc").collect()
    assert np.allclose([r["eigenvalue"] for r in rows], s[:5] ** 2 / len(z), rtol=1e-10)
    assert np.allclose([r["share"] for r in rows], s[:5] ** 2 / (s**2).sum(), rtol=1e-10)


def test_close_values_are_told_apart(spark):
    """A flat spectrum without planted groups: convergence needs several filtered rounds."""
    g = planted(400, 300, seed=4, groups=1)
    _, s, vt = np.linalg.svd(standard(g), full_matrices=False)
    scores, values = reduce.sample_pca(long(spark, g), 3, scaled=True)
    got = np.array([list(r["features"]) for r in scores.orderBy("sample_id").collect()])
    assert np.allclose(got, reduce.fix_signs(vt[:3].T) * s[:3], atol=1e-6)


def test_few_features_and_equal_rows(spark):
    g = np.array([[0, 1], [2, 1], [0, 1], [1, 1], [2, 1]])
    scores, values = reduce.sample_pca(long(spark, g), 4)
    assert values.count() == 1 and len(scores.first()["features"]) == 1
    with pytest.raises(ValueError):
        reduce.sample_pca(long(spark, np.ones((4, 3), int)), 2)


def test_vectors_are_scored_uncentred(spark):
    x = np.random.default_rng(2).normal(size=(60, 7)) * [5, 4, 3, 2, 1, 1, 1] + 10
    df = spark.createDataFrame([(f"s{i:02d}", "X", Vectors.dense(v)) for i, v in enumerate(x)], ["sample_id", "region", "features"])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x @ vt[:3].T
    scores, model = reduce.pca_features(df, 3)
    got = np.array([list(r["features"]) for r in scores.orderBy("sample_id").collect()])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-8)
    again = np.array([list(r["features"]) for r in model.project(df).orderBy("sample_id").collect()])
    assert np.allclose(again, got, atol=1e-8)


def test_scaled_pca_of_cells_equals_that_of_their_vectors(spark, cells):
    df, _ = cells
    regions = df.select("sample_id").distinct().withColumn("region", F.lit("X"))
    for mode in ("reference", "variance"):
        a = reduce.pca_scaled(reshape.sample_vectors(df, regions), 6, 0.8, mode)
        b = reduce.sample_pca_scaled(df, 6, 0.8, mode)
        a, b = (np.array([r["f"] for r in x.select("sample_id", vector_to_array("features").alias("f")).orderBy("sample_id").collect()]) for x in (a, b))
        assert a.shape == b.shape and np.allclose(np.abs(a), np.abs(b), atol=1e-7)


def test_a_cohort_beyond_the_former_limits(spark):
    """70,000 variants of 2,100 samples, most calls absent; the leading component is the planted split."""
    n, m = 2100, 70_000
    cells = spark.range(n * m // 350).select(
        (F.col("id") % n).alias("sample_no"), F.pmod(F.xxhash64("id"), F.lit(m)).alias("snp_idx")
    ).distinct()
    side = F.col("sample_no") % 2
    high = F.pmod(F.xxhash64("snp_idx", F.lit(3)), F.lit(2)) == side
    u = F.pmod(F.xxhash64("sample_no", "snp_idx"), F.lit(100))
    cells = cells.withColumn("dosage", F.when(u < F.when(high, 80).otherwise(5), 2).otherwise(0))
    cells = cells.withColumn("sample_id", F.format_string("s%05d", "sample_no"))
    scores = reduce.sample_pca_scaled(cells, 1, 1.0)
    rows = scores.select("sample_id", vector_to_array("features")[0].alias("x")).collect()
    x = np.array([r["x"] for r in rows]) - np.mean([r["x"] for r in rows])
    side = np.array([int(r["sample_id"][1:]) % 2 for r in rows])
    assert abs(((x > 0) == (side == 1)).mean() - 0.5) > 0.45


def test_thin_matrices_are_as_long_as_the_shorter_side(spark, monkeypatch):
    """Many samples of few features: no written table holds samples by the subspace's width; a block without a value scores 0."""
    g = planted(2100, 12)
    sizes, plain = [], subspace.cut_lineage

    def measured(df):
        out = plain(df)
        if "m" in out.columns:
            sizes.append(out.agg(F.sum(F.length("m"))).first()[0])
        return out

    monkeypatch.setattr(subspace, "cut_lineage", measured)
    n = 3 * subspace.SAMPLE_BLOCK
    more = spark.createDataFrame([(n - 1, 1, 1)], "sample_no bigint, snp_idx bigint, dosage int").withColumn("sample_id", F.lit("t"))
    scores, _ = reduce.sample_pca(long(spark, g).unionByName(more), 2)
    got = {r["sample_id"]: list(r["features"]) for r in scores.collect()}
    _, _, vt = np.linalg.svd(standard(g), full_matrices=False)
    assert got.pop("t") == [0.0, 0.0]
    assert np.allclose(np.array([got[i] for i in sorted(got)]), reduce.fix_signs(vt[:2].T), atol=1e-8)
    assert max(sizes) <= 2 * n * 8
