"""Power iteration, sketch and low-rank fit against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_subspace import long, planted, standard

from demescope.operators import factorise, reduce, subspace


def planted_rank(missing=0.0):
    """A whole matrix, the same with gaps (-1), and the columns' means of what is there."""
    rng = np.random.default_rng(8)
    whole = rng.integers(0, 4, (200, 2)) @ rng.integers(0, 4, (2, 50)) + 1
    g = np.where(rng.random(whole.shape) < missing, -1, whole)
    return whole, g, np.array([col[col >= 0].mean() for col in g.T])


def plain_tiles(spark, g):
    cells = long(spark, g)
    return subspace.long_tiles(reduce._long(cells), reduce._features(cells, F.lit(1.0), F.lit(True)), len(g))


def vectors(found, n):
    rows = subspace.sample_rows(found, np.eye(found.width)).orderBy("sample_no").collect()
    assert [r["sample_no"] for r in rows] == list(range(n))
    return np.array([r["f"] for r in rows])


def test_power_finds_one_after_another_and_ends_at_the_rank(spark):
    whole, g, mean = planted_rank()
    found = factorise.power(plain_tiles(spark, g), 4, tolerance=1e-6)
    u, s, _ = np.linalg.svd(whole - mean, full_matrices=False)
    assert found.width == 2 and np.allclose(found.values, s[:2], rtol=1e-8)  # centring takes the constant off
    assert np.allclose(np.abs(vectors(found, 200).T @ u[:, :2]), np.eye(2), atol=1e-5)


def test_sketch_over_two_feature_blocks(spark):
    g = planted(60, 1100, seed=3, groups=3)
    cells = long(spark, g)
    tiles = subspace.long_tiles(reduce._long(cells), reduce.standard_features(cells, 60), 60)
    _, s, vt = np.linalg.svd(standard(g), full_matrices=False)
    found = factorise.randomized(tiles, 2)
    assert np.allclose(found.values, s[:2], rtol=1e-4)
    assert np.allclose(np.abs((vectors(found, 60) * vt[:2].T).sum(axis=0)), 1, atol=1e-3)


def test_the_fit_recovers_a_planted_matrix_with_gaps(spark):
    whole, g, mean = planted_rank(missing=0.3)
    tiles = plain_tiles(spark, g)
    found = factorise.decomposed(tiles, 3, "GLRM")
    u, s, _ = np.linalg.svd(whole - mean, full_matrices=False)
    assert np.allclose(found.values, s[:3], rtol=1e-5)
    assert np.allclose(np.abs(vectors(found, 200).T @ u[:, :3]), np.eye(3), atol=1e-4)
    filled = factorise.decomposed(tiles, 3, "Randomized")  # gaps at the mean
    assert abs(filled.values[0] / s[0] - 1) > 0.05


def test_unknown_methods_and_no_variation_are_refused(spark):
    tiles = plain_tiles(spark, np.ones((20, 5), int))
    with pytest.raises(ValueError):
        factorise.decomposed(tiles, 2, "Exact")
    for method in ("Randomized", "GLRM"):
        with pytest.raises(ValueError):
            factorise.decomposed(tiles, 2, method)
