"""Leading singular vectors of matrices that are too tall and too wide for one machine.

A matrix of features by samples is a table of tiles: a block of features by a block of samples. Thin matrices
(samples or features by a few dozen columns) are tables of one row a block. A product joins tiles with copies of the
thin blocks, so tiles never move; partial products are summed in a tree of bounded groups. What reaches the driver
are square matrices of the thin width, whatever the data.

``leading`` iterates on a random subspace of the shorter side, samples or features: Rayleigh-Ritz, then a Chebyshev filter
that damps the spectrum below the subspace, then QR of the tall blocks in a tree. So thin matrices are as long as the
shorter side; vectors of the features are brought to the samples once, at the end.

Joins of matrices are merge joins: a small table of tiles would else be collected and broadcast for every product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from demescope.session import cut_lineage

FEATURE_BLOCK, SAMPLE_BLOCK = 1024, 2048
#: Columns of the subspace beyond the wanted ones, and matrices that meet in one group of a tree.
GUARD, FAN = 248, 16
TILES_PER_TASK = 8
MAX_ROUNDS, TOLERANCE = 60, 1e-10


def pack(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype=np.float64).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, width)


# --- tiles --------------------------------------------------------------------------------


@dataclass
class Tiles:
    """``fb, sb, data, mean, scale`` with features ``0..n_features-1`` and samples ``0..n_samples-1``.

    An entry counts as ``(x - mean) * scale`` of its feature, a missing one (NaN) as 0.
    """

    table: DataFrame
    n_features: int
    n_samples: int

    @property
    def feature_blocks(self) -> int:
        return -(-self.n_features // FEATURE_BLOCK)

    @property
    def sample_blocks(self) -> int:
        return -(-self.n_samples // SAMPLE_BLOCK)


def _standard(row, width: int) -> np.ndarray:
    data = np.frombuffer(row.data, dtype=row.kind).reshape(-1, width)
    mean, scale = np.asarray(row.mean)[:, None], np.asarray(row.scale)[:, None]
    if data.dtype.kind == "f":
        return np.nan_to_num((data - mean) * scale)
    return np.where(data < 0, 0.0, (data - mean) * scale)


def long_tiles(cells: DataFrame, features: DataFrame, n_samples: int) -> Tiles:
    """Tiles of long ``(sample_no, feature, value)``; ``features`` is ``(feature, no, mean, scale)`` with dense ``no``.

    Values are whole numbers of one byte (dosages), missing where no row exists or the value is null.
    """
    features = cut_lineage(features.select("feature", "no", "mean", "scale"))
    n = features.agg(F.coalesce(F.max("no") + 1, F.lit(0))).first()[0]
    block = F.floor(F.col("no") / FEATURE_BLOCK).cast("long").alias("fb")
    own = features.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("no", "mean", "scale"))).alias("f"))
    keyed = cells.filter(F.col("value").isNotNull()).join(features.select("feature", "no"), "feature").select(
        block,
        F.floor(F.col("sample_no") / SAMPLE_BLOCK).cast("long").alias("sb"),
        (F.col("no") % FEATURE_BLOCK).cast("int").alias("i"),
        (F.col("sample_no") % SAMPLE_BLOCK).cast("int").alias("j"),
        F.col("value").cast("byte").alias("x"),
    )

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fb, sb = key
        height, width = min(FEATURE_BLOCK, n - fb * FEATURE_BLOCK), min(SAMPLE_BLOCK, n_samples - sb * SAMPLE_BLOCK)
        m = np.full((height, width), -1, dtype=np.int8)
        m[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["x"].to_numpy()
        return pd.DataFrame([[fb, sb, "int8", m.tobytes()]], columns=["fb", "sb", "kind", "data"])

    tiles = keyed.groupBy("fb", "sb").applyInPandas(build, "fb long, sb long, kind string, data binary")
    scaled = tiles.join(own, "fb").select("fb", "sb", "kind", "data", F.col("f.mean").alias("mean"), F.col("f.scale").alias("scale"))
    return Tiles(cut_lineage(scaled), n, n_samples)


def vector_blocks(rows: DataFrame, key: str, values: str) -> DataFrame:
    """``key, fb, part``: the arrays cut into blocks of features."""
    last = F.floor((F.size(values) - 1) / FEATURE_BLOCK).cast("long")
    cut = rows.filter(F.size(values) > 0).select(key, F.col(values).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fb"))
    return cut.select(key, "fb", F.slice("v", (F.col("fb") * FEATURE_BLOCK + 1).cast("int"), F.lit(FEATURE_BLOCK)).alias("part"))


def vector_tiles(rows: DataFrame, n_samples: int, mean: DataFrame, width: int) -> Tiles:
    """Tiles of ``(sample_no, features array)``; ``mean`` is one row of arrays ``mean`` and ``scale``."""
    blocks = vector_blocks(rows, "sample_no", "features")
    both = mean.select(F.lit(0).alias("at"), F.arrays_zip("mean", "scale").alias("f"))
    own = vector_blocks(both, "at", "f").select("fb", F.col("part.mean").alias("mean"), F.col("part.scale").alias("scale"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.full((min(FEATURE_BLOCK, width - key[0] * FEATURE_BLOCK), min(SAMPLE_BLOCK, n_samples - key[1] * SAMPLE_BLOCK)), np.nan)
        m[:, pdf["j"].to_numpy()] = np.stack(pdf["part"].to_numpy()).T
        return pd.DataFrame([[*key, "float64", m.tobytes()]], columns=["fb", "sb", "kind", "data"])

    keyed = blocks.select(
        "fb", F.floor(F.col("sample_no") / SAMPLE_BLOCK).cast("long").alias("sb"), (F.col("sample_no") % SAMPLE_BLOCK).cast("int").alias("j"), "part"
    )
    tiles = keyed.groupBy("fb", "sb").applyInPandas(build, "fb long, sb long, kind string, data binary")
    return Tiles(cut_lineage(tiles.join(own, "fb")), width, n_samples)


# --- products -----------------------------------------------------------------------------


def _tree(parts: DataFrame, key: str, other: str, n: int, combine: Callable[[list[bytes]], bytes]) -> DataFrame:
    """Matrices of equal ``key`` brought together, at most FAN in a group; ``other`` tells ``n`` of them apart."""

    def meet(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*names, combine(list(pdf.sort_values(other)["m"]))]], columns=[key, other, "m"])

    while n > 1:
        parts = parts.groupBy(key, F.floor(F.col(other) / FAN).cast("long").alias(other)).applyInPandas(
            meet, f"{key} long, {other} long, m binary"
        )
        n = -(-n // FAN)
    return parts.select(key, "m")


def _sum(parts: list[bytes]) -> bytes:
    total = np.frombuffer(parts[0], dtype=np.float64).copy()
    for p in parts[1:]:
        total += np.frombuffer(p, dtype=np.float64)
    return total.tobytes()


def _stacked_r(width: int) -> Callable[[list[bytes]], bytes]:
    return lambda parts: pack(np.linalg.qr(np.vstack([unpack(p, width) for p in parts]), mode="r"))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


_PART = "fb long, sb long, m binary"


def _met(tiles: Tiles, copies: DataFrame) -> DataFrame:
    return tiles.table.join(copies.hint("merge"), ["fb", "sb"])


def forward(tiles: Tiles, thin: DataFrame, width: int) -> DataFrame:
    """``fb, m``: the matrix times samples x ``width`` blocks ``(sb, m)``."""
    n_samples = tiles.n_samples
    copies = thin.select("sb", "m", F.explode(_numbers(tiles.feature_blocks)).alias("fb"))

    def multiply(row):
        return [row.fb, row.sb, pack(_standard(row, min(SAMPLE_BLOCK, n_samples - row.sb * SAMPLE_BLOCK)) @ unpack(row.m, width))]

    return _tree(mapped(_met(tiles, copies), _PART, multiply), "fb", "sb", tiles.sample_blocks, _sum)


def backward(tiles: Tiles, thin: DataFrame, width: int) -> DataFrame:
    """``sb, m``: the transposed matrix times features x ``width`` blocks ``(fb, m)``."""
    n_samples = tiles.n_samples
    copies = thin.select("fb", "m", F.explode(_numbers(tiles.sample_blocks)).alias("sb"))

    def multiply(row):
        return [row.fb, row.sb, pack(_standard(row, min(SAMPLE_BLOCK, n_samples - row.sb * SAMPLE_BLOCK)).T @ unpack(row.m, width))]

    return _tree(mapped(_met(tiles, copies), _PART, multiply), "sb", "fb", tiles.feature_blocks, _sum)


def _image(raw: bytes | None, like: np.ndarray) -> np.ndarray:
    """A block's image; a block of samples without any value has none, which counts as 0."""
    return np.zeros_like(like) if raw is None else unpack(raw, like.shape[1])


def squared(tiles: Tiles, thin: DataFrame, width: int) -> DataFrame:
    """``sb, m``: the transposed matrix times the matrix times ``(sb, m)``."""
    if tiles.sample_blocks > 1:
        return backward(tiles, forward(tiles, thin, width), width)
    # A tile holds all samples, so its lines of the first product are whole at once.
    copies = thin.select("sb", "m", F.explode(_numbers(tiles.feature_blocks)).alias("fb"))
    n_samples = tiles.n_samples

    def multiply(row):
        z = _standard(row, n_samples)
        return [row.fb, row.sb, pack(z.T @ (z @ unpack(row.m, width)))]

    return _tree(mapped(_met(tiles, copies), _PART, multiply), "sb", "fb", tiles.feature_blocks, _sum)


def squared_features(tiles: Tiles, thin: DataFrame, width: int) -> DataFrame:
    """``fb, m``: the matrix times the transposed matrix times ``(fb, m)``."""
    if tiles.feature_blocks > 1:
        return forward(tiles, backward(tiles, thin, width), width)
    # A tile holds all features of its samples, and a task adds up its tiles.
    copies = thin.select("fb", "m", F.explode(_numbers(tiles.sample_blocks)).alias("sb"))
    n_samples = tiles.n_samples

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, at = None, 0
        for pdf in frames:
            for row in pdf.itertuples():
                z = _standard(row, min(SAMPLE_BLOCK, n_samples - row.sb * SAMPLE_BLOCK))
                part = z @ (z.T @ unpack(row.m, width))
                total, at = (part, row.sb) if total is None else (total + part, at)
        if total is not None:
            yield pd.DataFrame([[0, at, pack(total)]], columns=["fb", "sb", "m"])

    return _tree(_met(tiles, copies).mapInPandas(multiply, _PART), "fb", "sb", tiles.sample_blocks, _sum)


def mapped(blocks: DataFrame, schema: str, make: Callable) -> DataFrame:
    """One row from each row of a thin table; ``make`` takes the row as a named tuple and returns a list."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():  # matrices go out one by one, so a task holds those it reads and one more
                yield pd.DataFrame([make(row)], columns=names)

    return blocks.mapInPandas(run, schema)


def _small(blocks: DataFrame, n: int, combine: Callable) -> np.ndarray | None:
    """The matrices ``(sb, m)`` of all blocks combined to one, on the driver."""
    row = _tree(blocks.withColumn("all", F.lit(0).cast("long")).select("all", "sb", "m"), "all", "sb", n, combine).first()
    return None if row is None else np.frombuffer(row["m"], dtype=np.float64)


# --- the iteration ------------------------------------------------------------------------


@dataclass
class Leading:
    """Singular values, descending, and the samples' unit vectors as blocks ``(sb, m)`` of ``width`` columns."""

    values: np.ndarray
    blocks: DataFrame
    rounds: int

    @property
    def width(self) -> int:
        return len(self.values)


def _orthonormal(blocks: DataFrame, r: np.ndarray) -> tuple[DataFrame, int]:
    """Blocks times the inverse of their triangular factor; directions that vanish are left out.

    Columns are brought to one length first, as a filter lets each grow by its own power.
    """
    width = r.shape[1]
    lengths = np.linalg.norm(r, axis=0)
    lengths[lengths == 0] = 1.0
    _, s, vt = np.linalg.svd(r / lengths)
    keep = s > 1e-12 * s[0]
    turn = (vt[: len(s)][keep] / s[keep][:, None]).T / lengths[:, None]
    return mapped(blocks, "sb long, m binary", lambda row: [row.sb, pack(unpack(row.m, width) @ turn)]), int(keep.sum())


def _factor(blocks: DataFrame, width: int, n: int) -> np.ndarray:
    """The triangular factor of tall blocks: QR of each, then of their factors in a tree."""
    local = mapped(blocks, "sb long, m binary", lambda row: [row.sb, pack(np.linalg.qr(unpack(row.m, width), mode="r"))])
    return _small(local, n, _stacked_r(width)).reshape(-1, width)


def leading(tiles: Tiles, k: int, seed: int = 1234, tolerance: float = TOLERANCE) -> Leading:
    """The ``k`` leading singular values and sample-side vectors.

    Done when ``|A v - s^2 v|`` is below ``tolerance`` times the largest ``s^2`` for each of them. The method is the
    same at every size; a subspace that holds all of the shorter side is exact after one round.
    """
    spark = tiles.table.sparkSession
    k = min(k, tiles.n_samples, tiles.n_features)
    tasks = max(1, -(-tiles.sample_blocks * tiles.feature_blocks // TILES_PER_TASK))
    fixed = tiles.table.repartition(tasks, "fb", "sb").persist(StorageLevel.MEMORY_AND_DISK)
    tiles = Tiles(fixed, tiles.n_features, tiles.n_samples)
    try:
        if tiles.n_features >= tiles.n_samples:
            return _iterated(spark, lambda q, w: squared(tiles, q, w), tiles.n_samples, SAMPLE_BLOCK, k, seed, tolerance)

        def product(q: DataFrame, w: int) -> DataFrame:
            return squared_features(tiles, q.withColumnRenamed("sb", "fb"), w).withColumnRenamed("fb", "sb")

        found = _iterated(spark, product, tiles.n_features, FEATURE_BLOCK, k, seed, tolerance)
        return Leading(found.values, _on_samples(tiles, found), found.rounds)
    finally:
        fixed.unpersist()


def _on_samples(tiles: Tiles, found: Leading) -> DataFrame:
    """The samples' unit vectors ``(sb, m)`` from the features' ones: the transposed matrix times them over the values."""
    w, s, n = found.width, found.values, tiles.n_samples
    image = backward(tiles, found.blocks.withColumnRenamed("sb", "fb"), w)
    every = tiles.table.sparkSession.range(tiles.sample_blocks).select(F.col("id").alias("sb"))

    def scaled(row):
        if row.m is None:  # no sample of the block has a value
            return [row.sb, pack(np.zeros((min(SAMPLE_BLOCK, n - row.sb * SAMPLE_BLOCK), w)))]
        return [row.sb, pack(unpack(row.m, w) / s)]

    return cut_lineage(mapped(every.join(image.hint("merge"), "sb", "left"), "sb long, m binary", scaled))


def _iterated(spark: SparkSession, product: Callable, n: int, size: int, k: int, seed: int, tolerance: float) -> Leading:
    """Leading eigenvectors, as blocks of ``size`` rows, of a square matrix of ``n`` rows known by its ``product`` with thin ones."""
    nb = -(-n // size)
    width = max(k + GUARD, 2 * k)
    width = n if 5 * width > 4 * n else width  # random columns of nearly full rank are better replaced by all

    def draw(row, width=width):
        first = row.sb * size
        here = min(size, n - first)
        if width == n:
            return [row.sb, pack(np.eye(here, n, first))]
        return [row.sb, pack(np.random.default_rng([seed, row.sb]).standard_normal((here, width)) / np.sqrt(n))]

    q = mapped(spark.range(nb).select(F.col("id").alias("sb")), "sb long, m binary", draw)
    rounds = 0
    while True:
        rounds += 1
        image = product(q, width)
        w = width

        def measure(row, w=w):
            x = unpack(row.m, w)
            y = _image(row.y, x)
            return [row.sb, row.m, pack(y), pack(np.vstack([x.T @ x, x.T @ y]))]

        both = q.join(image.withColumnRenamed("m", "y").hint("merge"), "sb", "left")
        both = cut_lineage(mapped(both, "sb long, m binary, y binary, s binary", measure))
        sums = _small(both.select("sb", F.col("s").alias("m")), nb, _sum).reshape(2, w, w)
        square, turn = np.linalg.eigh(sums[0])
        white = turn / np.sqrt(np.maximum(square, 1e-12 * square[-1]))
        theta, u = np.linalg.eigh(white.T @ ((sums[1] + sums[1].T) / 2) @ white)
        theta, u = theta[::-1], (white @ u)[:, ::-1]
        here = min(k, int((theta > 1e-13 * max(theta[0], 1e-300)).sum()))
        if here == 0:
            raise ValueError("no varying feature left for the decomposition")

        def gaps(row, w=w, u=u[:, :here], t=theta[:here]):
            r = unpack(row.y, w) @ u - unpack(row.m, w) @ u * t
            return [row.sb, pack((r * r).sum(axis=0))]

        error = np.sqrt(_small(mapped(both, "sb long, m binary", gaps), nb, _sum)) / theta[0]
        if error.max() <= tolerance or w >= n or rounds >= MAX_ROUNDS:
            found = mapped(both.select("sb", "m"), "sb long, m binary", lambda row, w=w, u=u[:, :here]: [row.sb, pack(unpack(row.m, w) @ u)])
            return Leading(np.sqrt(theta[:here]), cut_lineage(found), rounds)
        # Chebyshev polynomial that stays small on 0..low and grows above; its degree follows the way to go.
        low = max(theta[-1], 1e-9 * theta[0])
        x = max(2 * theta[here - 1] / low - 1, 1 + 1e-9)
        wanted = np.log(max(error.max() / tolerance, 10.0)) / np.arccosh(x)
        degree = int(np.clip(np.ceil(wanted) + 1, 2, 5 if rounds == 1 else 10))
        half = low / 2

        def first(row, w=w, u=u, half=half):
            x, y = unpack(row.m, w) @ u, unpack(row.y, w) @ u
            return [row.sb, pack((y - half * x) / half), pack(x)]

        state = cut_lineage(mapped(both, "sb long, m binary, before binary", first))
        for _ in range(degree - 1):

            def next_(row, w=w, half=half):
                now = unpack(row.m, w)
                new = 2 * (_image(row.y, now) - half * now) / half - unpack(row.before, w)
                return [row.sb, pack(new), row.m]

            image = product(state.select("sb", "m"), w)
            step = state.join(image.withColumnRenamed("m", "y").hint("merge"), "sb", "left")
            state = cut_lineage(mapped(step, "sb long, m binary, before binary", next_))
        q, width = _orthonormal(state, _factor(state, w, nb))


def signed(found: Leading) -> np.ndarray:
    """Per column 1 or -1, so that the entry of largest magnitude (the first of equals) becomes positive."""
    w = found.width

    def lead(row):
        m = unpack(row.m, w)
        at = np.abs(m).argmax(axis=0)
        return [row.sb, pack(m[at, np.arange(w)])]

    def larger(parts):
        m = np.vstack([unpack(p, w) for p in parts])
        return pack(m[np.abs(m).argmax(axis=0), np.arange(w)])

    blocks = found.blocks.agg(F.count("*")).first()[0]
    sign = np.sign(_small(mapped(found.blocks, "sb long, m binary", lead), blocks, larger))
    return np.where(sign == 0, 1.0, sign)


def sample_rows(found: Leading, turn: np.ndarray) -> DataFrame:
    """``sample_no, f``: each sample's line of the blocks times a small matrix."""
    w = found.width

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                m = unpack(row.m, w) @ turn
                yield pd.DataFrame({"sample_no": row.sb * SAMPLE_BLOCK + np.arange(len(m)), "f": list(m)})

    return found.blocks.mapInPandas(run, "sample_no long, f array<double>")


def total_square(tiles: Tiles) -> float:
    """Sum of all squared entries."""
    n = tiles.n_samples
    own = mapped(tiles.table, "v double", lambda r: [float((_standard(r, min(SAMPLE_BLOCK, n - r.sb * SAMPLE_BLOCK)) ** 2).sum())])
    return own.agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]


def loadings(tiles: Tiles, found: Leading) -> DataFrame:
    """``fb, m``: the features' unit vectors in blocks."""
    w, s = found.width, found.values
    scaled = mapped(found.blocks, "sb long, m binary", lambda row: [row.sb, pack(unpack(row.m, w) / s)])
    return forward(tiles, scaled, w)


def feature_sums(tiles: Tiles, thin: DataFrame, width: int) -> np.ndarray:
    """Sum over the features of ``mean * scale`` times each line of a thin matrix: what centring takes off the scores."""
    own = tiles.table.groupBy("fb").agg(F.first("mean").alias("mean"), F.first("scale").alias("scale"))
    shift = mapped(
        own.join(thin, "fb"), "sb long, m binary", lambda row: [row.fb, pack((np.asarray(row.mean) * np.asarray(row.scale)) @ unpack(row.m, width))]
    )
    return _small(shift, tiles.feature_blocks, _sum)
