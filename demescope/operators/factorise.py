"""Three more ways to the leading components of tiles: power iteration, Gaussian sketch, low-rank fit to the cells present.

All return ``subspace.Leading``. Like there, tiles stay where they are, thin matrices are blocks, and the driver sees
matrices of the thin width only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from demescope.operators import subspace
from demescope.operators.subspace import SAMPLE_BLOCK, Leading, Tiles, mapped, pack, unpack
from demescope.session import cut_lineage

METHODS = ("GramSVD", "Power", "Randomized", "GLRM")
OVERSAMPLE, SKETCH_ROUNDS = 10, 4
POWER_ROUNDS, POWER_TOLERANCE = 1000, 1e-8
FIT_ROUNDS, FIT_TOLERANCE, RIDGE = 200, 1e-12, 1e-9


@contextmanager
def _placed(tiles: Tiles) -> Iterator[Tiles]:
    tasks = max(1, -(-tiles.sample_blocks * tiles.feature_blocks // subspace.TILES_PER_TASK))
    table = tiles.table.repartition(tasks, "fb", "sb").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Tiles(table, tiles.n_features, tiles.n_samples)
    finally:
        table.unpersist()


def _drawn(tiles: Tiles, width: int, seed: int) -> DataFrame:
    """``sb, m``: normal numbers, the same for a block whatever the partitions."""
    n = tiles.n_samples

    def draw(row):
        size = min(SAMPLE_BLOCK, n - row.sb * SAMPLE_BLOCK)
        return [row.sb, pack(np.random.default_rng([seed, row.sb]).standard_normal((size, width)) / np.sqrt(n))]

    blocks = tiles.table.sparkSession.range(tiles.sample_blocks).select(F.col("id").alias("sb"))
    return mapped(blocks, "sb long, m binary", draw)


def _summed(blocks: DataFrame, n: int, make) -> np.ndarray:
    """Sum over the blocks of the small matrices that ``make`` gives."""
    return subspace._small(mapped(blocks, "sb long, m binary", lambda row: [row.sb, pack(make(row))]), n, subspace._sum)


def _with_image(tiles: Tiles, thin: DataFrame, width: int) -> DataFrame:
    """The thin table with ``y``, its blocks' images under the transposed matrix times the matrix, written."""
    image = subspace.squared(tiles, thin.select("sb", "m"), width).withColumnRenamed("m", "y")
    return cut_lineage(thin.join(image, "sb", "left"))


# --- power iteration ----------------------------------------------------------------------


def power(tiles: Tiles, k: int, seed: int = 1234, tolerance: float = POWER_TOLERANCE, max_rounds: int = POWER_ROUNDS) -> Leading:
    """One component after another: repeated products, without the directions found before (deflation).

    A component is done when ``|A v - s^2 v|`` is below ``tolerance`` times ``s^2``, or after ``max_rounds`` products;
    components whose values are close need many. Ends before ``k`` where the next ``s^2`` is below ``tolerance`` times the largest.
    """
    nb, values, rounds = tiles.sample_blocks, [], 0
    basis = mapped(_drawn(tiles, 1, seed), "sb long, b binary", lambda row: [row.sb, b""])
    with _placed(tiles) as tiles:
        for j in range(min(k, tiles.n_samples, tiles.n_features)):
            start = _drawn(tiles, 1, seed + j).join(basis, "sb")
            least = max(tolerance, 1e-12) * values[0] ** 2 if values else 1e-300
            for turn in range(max_rounds):
                rounds += 1
                both = _with_image(tiles, start, 1)

                def parts(row, j=j):
                    v, b = unpack(row.m, 1), unpack(row.b, j) if j else np.zeros((len(row.m) // 8, 0))
                    return v, subspace._image(row.y, v), b

                def first(row, parts=parts):
                    v, y, b = parts(row)
                    return np.concatenate([v.T @ v, v.T @ y, b.T @ y, b.T @ v]).ravel()

                sums = _summed(both, nb, first)
                theta, c, d = sums[1] / max(sums[0], 1e-300), sums[2 : 2 + j, None], sums[2 + j :, None]

                def second(row, parts=parts, c=c, d=d, theta=theta):
                    v, y, b = parts(row)
                    w, v = y - b @ c, v - b @ d
                    return np.array([(w * w).sum(), ((w - theta * v) ** 2).sum(), (v * v).sum()])

                length, gap, own = np.sqrt(_summed(both, nb, second))
                if length <= least:
                    break

                def next_(row, parts=parts, c=c, length=length):
                    _, y, b = parts(row)
                    return [row.sb, pack((y - b @ c) / length), row.b]

                start = mapped(both.select("sb", "m", "y", "b"), "sb long, m binary, b binary", next_)
                if turn and gap <= tolerance * theta * own:
                    break
            if length <= least:
                break
            values.append(np.sqrt(length / own) if own else 0.0)

            def added(row, j=j):
                v = unpack(row.m, 1)
                return [row.sb, pack(np.hstack([unpack(row.b, j), v]) if j else v)]

            basis = cut_lineage(mapped(start, "sb long, b binary", added))
    if not values:
        raise ValueError("no varying feature left for the decomposition")
    return Leading(np.array(values), basis.withColumnRenamed("b", "m"), rounds)


# --- Gaussian sketch ----------------------------------------------------------------------


def randomized(tiles: Tiles, k: int, seed: int = 1234, oversample: int = OVERSAMPLE, rounds: int = SKETCH_ROUNDS) -> Leading:
    """The best components within the image of ``k + oversample`` random directions after ``rounds`` products.

    A fixed amount of work: the smaller the values beyond the sketch are to the wanted ones, the closer the result.
    """
    n, nb = tiles.n_samples, tiles.sample_blocks
    k = min(k, n, tiles.n_features)
    width = min(n, k + oversample)
    with _placed(tiles) as tiles:
        q = _drawn(tiles, width, seed)
        for _ in range(rounds):

            def image(row, w=width):
                return [row.sb, pack(subspace._image(row.y, unpack(row.m, w)))]

            q = mapped(_with_image(tiles, q, width), "sb long, m binary", image)
            factor = subspace._factor(q, width, nb)
            if not np.abs(factor).max() > 0:
                raise ValueError("no varying feature left for the decomposition")
            q, width = subspace._orthonormal(q, factor)
        both = _with_image(tiles, q, width)
        inner = _summed(both, nb, lambda row, w=width: unpack(row.m, w).T @ subspace._image(row.y, unpack(row.m, w))).reshape(width, width)
        theta, u = np.linalg.eigh((inner + inner.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        here = min(k, int((theta > 1e-13 * theta[0]).sum()))
        found = mapped(both.select("sb", "m"), "sb long, m binary", lambda row, w=width: [row.sb, pack(unpack(row.m, w) @ u[:, :here])])
        return Leading(np.sqrt(theta[:here]), cut_lineage(found), rounds)


# --- low-rank fit to the cells present ----------------------------------------------------


def _normal(tiles: Tiles, thin: DataFrame, own: str, other: str, k: int) -> DataFrame:
    """``own, m``: per line of block ``own`` the normal equations (k x k, then k) of its cells against ``thin`` (``other, m``)."""
    n = tiles.n_samples
    blocks = {"fb": tiles.feature_blocks, "sb": tiles.sample_blocks}
    copies = thin.select(other, "m", F.explode(subspace._numbers(blocks[own])).alias(own))

    def equations(row) -> bytes:
        width = min(SAMPLE_BLOCK, n - row.sb * SAMPLE_BLOCK)
        data = np.frombuffer(row.data, dtype=row.kind).reshape(-1, width)
        there = (~np.isnan(data) if data.dtype.kind == "f" else data >= 0).astype(np.float64)
        values = subspace._standard(row, width)
        if own == "sb":
            there, values = there.T, values.T
        x = unpack(row.m, k)
        return pack(np.hstack([there @ (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k), values @ x]))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({own: pdf[own], other: pdf[other], "m": [equations(r) for r in pdf.itertuples()]})

    parts = tiles.table.join(copies, ["fb", "sb"]).mapInPandas(multiply, f"{own} long, {other} long, m binary")
    return subspace._tree(parts, own, other, blocks[other], subspace._sum)


def low_rank(
    tiles: Tiles, k: int, seed: int = 1234, ridge: float = RIDGE, tolerance: float = FIT_TOLERANCE, max_rounds: int = FIT_ROUNDS
) -> Leading:
    """Least squares over the cells present only, by turns for features and samples (alternating least squares).

    Missing cells have no say, where the other methods count them as the mean. ``ridge`` is added to every normal
    equation, so lines with fewer cells than ``k`` have a solution. Ends when a round takes less than ``tolerance`` of the total
    square off the loss. The factors are turned into singular values and vectors of their product.
    """
    n, nb = tiles.n_samples, tiles.sample_blocks
    k = min(k, n, tiles.n_features)
    with _placed(tiles) as tiles:
        total = subspace.total_square(tiles)
        if not total > 0:
            raise ValueError("no varying feature left for the decomposition")

        def solved(row) -> tuple[np.ndarray, float]:
            both = unpack(row.m, k * k + k)
            left, right = both[:, : k * k].reshape(-1, k, k), both[:, k * k :]
            x = np.linalg.solve(left + ridge * np.eye(k), right[:, :, None])[:, :, 0]
            return x, float(np.einsum("ri,rij,rj->", x, left, x) - 2 * (x * right).sum())

        samples, before = _drawn(tiles, k, seed), np.inf
        every = tiles.table.sparkSession.range(nb).select(F.col("id").alias("sb"))
        for rounds in range(1, max_rounds + 1):
            features = cut_lineage(mapped(_normal(tiles, samples, "fb", "sb", k), "fb long, m binary", lambda row: [row.fb, pack(solved(row)[0])]))

            def fitted(row):
                if row.m is None:  # a block of samples without any cell
                    return [row.sb, pack(np.zeros((min(SAMPLE_BLOCK, n - row.sb * SAMPLE_BLOCK), k))), 0.0]
                x, off = solved(row)
                return [row.sb, pack(x), off]

            equations = every.join(_normal(tiles, features, "sb", "fb", k), "sb", "left")
            samples = cut_lineage(mapped(equations, "sb long, m binary, off double", fitted))
            loss = total + samples.agg(F.sum("off")).first()[0]
            samples = samples.select("sb", "m")
            if before - loss <= tolerance * total:
                break
            before = loss
        r_x = subspace._factor(samples, k, nb)
        r_y = subspace._factor(features.withColumnRenamed("fb", "sb"), k, tiles.feature_blocks)
        _, s, vt = np.linalg.svd(r_x @ r_y.T)
        keep = s > 1e-12 * s[0]
        turn = (r_y.T @ vt.T[:, : len(s)][:, keep]) / s[keep]
        found = mapped(samples, "sb long, m binary", lambda row: [row.sb, pack(unpack(row.m, k) @ turn)])
        return Leading(s[keep], cut_lineage(found), rounds)


def decomposed(tiles: Tiles, k: int, method: str = "GramSVD", seed: int = 1234) -> Leading:
    """Leading components by the named method."""
    ways = dict(zip(METHODS, (subspace.leading, power, randomized, low_rank), strict=True))
    if method not in ways:
        raise ValueError(f"method must be one of {METHODS}")
    return ways[method](tiles, k, seed)
