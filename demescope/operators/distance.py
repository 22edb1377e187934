"""Distances between samples, and summaries of all pairwise distances that never list the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demescope.functions.vectors import METRICS
from demescope.operators import balls
from demescope.operators.tiles import MISSING, difference_counts, dosage_tiles, pair_tiles, spread_tile
from demescope.session import cut_lineage, held

SAMPLE_TILE = 512
SNP_BLOCK = 8_192
#: Tables of counts that meet in one group of a tree.
FAN = 16
POINT_TILE = balls.TILE
#: Partitions on a side of a product of tiles at least (if there are as many tiles), and tiles in one at most, about.
SIDE_PARTS, TILES_PER_PART = 16, 16
#: Bytes of the tiles that a task of ``SampleDistances.times`` walks through for each of its own.
SIDE_BYTES = 32 << 20


def _all_tile_pairs(tiles: DataFrame) -> DataFrame:
    """``tile_a <= tile_b`` over the tile numbers in use: each tile lists its later partners."""
    n = tiles.agg((F.max("tile") + 1).alias("n")).scalar()
    numbers = tiles.select("tile").distinct()
    return numbers.select(
        F.col("tile").alias("tile_a"), F.explode(F.sequence(F.col("tile"), n - 1)).alias("tile_b")
    )


def _pair_rows(ids_a: np.ndarray, ids_b: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row per pair ``a < b`` of two tiles from their three tables of counts."""
    i, j = np.nonzero(ids_a[:, None] < ids_b[None, :])
    valid, one, two = (m[i, j].astype(np.int64) for m in n)
    return pd.DataFrame({"sample_a": ids_a[i], "sample_b": ids_b[j], "n_valid": valid, "off_by_1": one, "off_by_2": two})


def _sample_tiles(cells: DataFrame, tile: int, width: int) -> DataFrame:
    """``tile, ids, data``: the numbered samples of a tile, also those without a call, with all their variants."""
    called = F.col("dosage").between(0, 2) & F.col("snp_idx").isNotNull()
    keyed = cells.filter(F.col("sample_no").isNotNull()).select(
        F.floor(F.col("sample_no") / tile).cast("long").alias("tile"),
        F.col("sample_no").cast("long").alias("_p"),
        F.coalesce("snp_idx", F.lit(0)).cast("int").alias("_c"),
        F.when(called, F.col("dosage")).otherwise(MISSING).cast("byte").alias("_d"),
    )

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf["_p"].to_numpy(), return_inverse=True)
        col, d = pdf["_c"].to_numpy(), pdf["_d"].to_numpy()
        m = np.full((len(ids), width), MISSING, dtype=np.int8)
        known = d != MISSING
        m[row[known], col[known]] = d[known]
        return pd.DataFrame([[*key, ids.tolist(), m.tobytes()]], columns=["tile", "ids", "data"])

    return keyed.groupBy("tile").applyInPandas(build, "tile bigint, ids array<bigint>, data binary")


def _met(left: DataFrame, right: DataFrame, where: Column | None = None) -> DataFrame:
    """Every tile of one table with every one of the other: partitions are read again for each partner, nothing is shuffled."""
    one = left.select(*[F.col(c).alias(f"{c}_a") for c in left.columns])
    two = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns]).hint("shuffle_replicate_nl")
    return one.crossJoin(two) if where is None else one.join(two, where)


def _side_parts(tiles: int) -> int:
    return max(1, min(tiles, SIDE_PARTS), -(-tiles // TILES_PER_PART))


def _matrix(ids, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int8).reshape(len(ids), -1)


def _listed_differences(cells: DataFrame, tile: int, last: int, width: int, schema: str) -> DataFrame:
    """The rows of ``sample_differences`` where a tile holds all variants: listed where tiles meet."""
    tiles = _sample_tiles(cells, tile, width).repartition(_side_parts(last // tile + 1), "tile")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                a, b = _matrix(r.ids_a, r.data_a), _matrix(r.ids_b, r.data_b)
                yield _pair_rows(np.asarray(r.ids_a), np.asarray(r.ids_b), np.stack(difference_counts(a, b)))

    return _met(tiles, tiles, F.col("tile_a") <= F.col("tile_b")).mapInPandas(listed, schema)


def sample_differences(cells: DataFrame, tile: int = SAMPLE_TILE, block: int = SNP_BLOCK) -> DataFrame:
    """``(sample_a, sample_b, n_valid, off_by_1, off_by_2)`` for all pairs of numbered samples.

    The output is the full proximity table (its size is the square of the cohort); the work is
    tile products over blocks of variants, so genotypes are never joined pair by pair. Pairs are listed last, where
    they are counted. With one block of variants tiles meet without a shuffle, so beside the output a run needs no more disk than
    the dosages; with several the tables of counts are added up first, as matrices in a tree of bounded groups.
    """
    schema = "sample_a bigint, sample_b bigint, n_valid bigint, off_by_1 bigint, off_by_2 bigint"
    last, variants = cells.agg(F.max("sample_no"), F.max("snp_idx")).first()
    n = (variants or 0) // block + 1
    if n == 1:
        return _listed_differences(cells, tile, last or 0, (variants or 0) + 1, schema)
    tiles = dosage_tiles(cells, "sample_no", "snp_idx", tile, block)
    members = cells.select("sample_no").distinct().groupBy(
        F.floor(F.col("sample_no") / tile).cast("long").alias("tile")
    ).agg(F.sort_array(F.collect_list("sample_no")).alias("members"))
    pairs = _all_tile_pairs(members)
    for side in ("a", "b"):
        pairs = pairs.join(members.select(F.col("tile").alias(f"tile_{side}"), F.col("members").alias(f"ids_{side}")), f"tile_{side}")

    def packed(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        about = (left if len(left) else right).iloc[0]
        ids_a, ids_b = np.asarray(about["ids_a"]), np.asarray(about["ids_b"])
        counts = np.stack(difference_counts(spread_tile(left, ids_a), spread_tile(right, ids_b))).astype(np.int32)
        return pd.DataFrame([[*key, ids_a.tolist(), ids_b.tolist(), counts.tobytes()]], columns=["tile_a", "tile_b", "block", "ids_a", "ids_b", "n"])

    def total(pdf: pd.DataFrame) -> np.ndarray:
        out = np.frombuffer(pdf["n"].iloc[0], dtype=np.int32).copy()
        for raw in pdf["n"].iloc[1:]:
            out += np.frombuffer(raw, dtype=np.int32)
        return out

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame([[*key, first["ids_a"], first["ids_b"], total(pdf).tobytes()]], columns=pdf.columns)

    def unpacked(pdf: pd.DataFrame) -> pd.DataFrame:
        ids_a, ids_b = (np.asarray(pdf[c].iloc[0]) for c in ("ids_a", "ids_b"))
        return _pair_rows(ids_a, ids_b, total(pdf).reshape(3, len(ids_a), len(ids_b)))

    table = "tile_a bigint, tile_b bigint, block bigint, ids_a array<bigint>, ids_b array<bigint>, n binary"
    parts = pair_tiles(tiles, pairs, (), packed, table)
    while n > FAN:
        parts = parts.groupBy("tile_a", "tile_b", F.floor(F.col("block") / FAN).cast("long").alias("block")).applyInPandas(added, table)
        n = -(-n // FAN)
    return parts.groupBy("tile_a", "tile_b").applyInPandas(unpacked, schema)


def _power(metric: str, p: float) -> float:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return {"hamming": 0.0, "euclidean": 2.0, "manhattan": 1.0}.get(metric, float(p))


def distance_from_differences(metric: str, p: float = 2, rescale_to: Column | None = None) -> Column:
    """A metric from the difference counts of a pair.

    Dosages differ by 0, 1 or 2, so the counts hold all a Minkowski metric needs. Only variants
    called in both count; ``rescale_to`` (a number of variants) scales the sum up to it.
    """
    power = _power(metric, p)
    one, two = F.col("off_by_1").cast("double"), F.col("off_by_2").cast("double")
    scale = F.lit(1.0) if rescale_to is None else rescale_to / F.col("n_valid")
    if metric == "hamming":
        return (one + two) * scale
    return F.pow((one + F.lit(2.0**power) * two) * scale, F.lit(1.0 / power))


def sample_distances(
    cells: DataFrame,
    metric: str = "euclidean",
    p: float = 2,
    tile: int = SAMPLE_TILE,
    block: int = SNP_BLOCK,
    rescale: bool = False,
    listed: bool = True,
) -> DataFrame | SampleDistances:
    """``(sample_a, sample_b, n_valid, distance)`` of all pairs, ``sample_a < sample_b``.

    With ``listed=False`` the distances come as ``SampleDistances``, for work that needs no list of them.
    """
    power = _power(metric, p)
    total = cells.agg(F.count_distinct("snp_idx").cast("double").alias("n")).scalar() if rescale else None
    if not listed:
        last, variants = cells.agg(F.max("sample_no"), F.max("snp_idx")).first()
        width = (variants or 0) + 1
        tile = max(1, min(tile, tile * block // width))  # a tile holds all variants
        known = cells.agg(total.alias("n")).first()[0] if rescale else None
        return SampleDistances(cut_lineage(_sample_tiles(cells, tile, width)), (last or 0) // tile + 1, (last or 0) * width, power, known)
    pairs = sample_differences(cells, tile, block)
    return pairs.select(
        "sample_a", "sample_b", "n_valid", distance_from_differences(metric, p, total).alias("distance")
    )


# --- squared distances times a few columns, for scaling ------------------------------------

#: ``times(x)``: the squared distances times the lines of ``x``, and which samples have any.
Times = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _added(found: DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds up ``(ids, m)``, lines of a product for the samples named."""
    out, there = np.zeros(x.shape), np.zeros(len(x), dtype=bool)
    for r in found.collect():
        ids = np.frombuffer(r["ids"], dtype=np.int64)
        out[ids] += np.frombuffer(r["m"], dtype=np.float64).reshape(len(ids), -1)
        there[ids] = True
    return out, there


@dataclass
class SampleDistances:
    """Distances of all pairs of numbered samples that are neither listed nor kept: each product counts them anew.

    ``tiles`` are ``tile, ids, data``; ``size`` are their bytes, ``total`` is what sums are scaled up to, if they are.
    """

    tiles: DataFrame
    n_tiles: int
    size: int
    power: float
    total: float | None

    def sides(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indicators of the dosages and of the calls of a tile."""
        step = 2.0**self.power
        exact = step == int(step) and step * m.shape[1] < 1 << 24  # sums are whole numbers that floats hold
        zero, one, two = ((m == d).astype(np.float32 if exact else np.float64) for d in range(3))
        return np.concatenate([zero, one, two], axis=1), (m >= 0).astype(np.float32)

    def squares(self, ids_a: np.ndarray, a: tuple[np.ndarray, np.ndarray], ids_b: np.ndarray, b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Squared distances of the samples of two tiles, given by their ``sides``."""
        step = b[0].dtype.type(2.0**self.power)
        zero, one, two = np.split(b[0], 3, axis=1)
        sums = (a[0] @ np.concatenate([one + step * two, zero + two, one + step * zero], axis=1).T).astype(np.float64)
        if self.total is not None:
            valid = a[1] @ b[1].T
            if valid.min() == 0:
                if ((valid == 0) & (ids_a[:, None] != ids_b[None, :])).any():
                    raise ValueError("a pair of samples has no variant called in both, so its distance can't be scaled")
                valid = np.maximum(valid, 1)
            sums *= self.total
            np.divide(sums, valid, out=sums)
        return sums if self.power == 2 else sums * sums if self.power in (0, 1) else sums ** (2.0 / self.power)

    @contextmanager
    def ready(self, n: int) -> Iterator[Times]:
        """Products with matrices of ``n`` lines. Tiles meet without a shuffle; a task sends back lines of its own samples."""
        with held(self.tiles.repartition(self.n_tiles, "tile")) as left, held(
            self.tiles.repartition(1 + self.size // SIDE_BYTES, "tile")
        ) as right:
            yield lambda x: self._times(left, right, x)

    def _times(self, left: DataFrame, right: DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent, kernel = left.sparkSession.sparkContext.broadcast(x), SampleDistances(None, 0, 0, self.power, self.total)

        def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, ids, own, sums = None, None, None, None
            for pdf in frames:
                for r in pdf.itertuples():
                    if r.tile_a != at:
                        if at is not None:
                            yield pd.DataFrame([[ids.tobytes(), sums.tobytes()]], columns=["ids", "m"])
                        at, ids, own = r.tile_a, np.asarray(r.ids_a), kernel.sides(_matrix(r.ids_a, r.data_a))
                        sums = np.zeros((len(ids), sent.value.shape[1]))
                    other = np.asarray(r.ids_b)
                    sums += kernel.squares(ids, own, other, kernel.sides(_matrix(other, r.data_b))) @ sent.value[other]
            if at is not None:
                yield pd.DataFrame([[ids.tobytes(), sums.tobytes()]], columns=["ids", "m"])

        out = _added(_met(left, right).mapInPandas(multiply, "ids binary, m binary"), x)
        sent.destroy()
        return out


@dataclass
class ListedDistances:
    """Distances from a table of pairs, squared and cut into tiles ``a, b, m`` (NaN where no pair is listed), each pair once."""

    tiles: DataFrame
    tile: int

    @classmethod
    def of(cls, pairs: DataFrame, tile: int = SAMPLE_TILE) -> ListedDistances:
        low, high = F.least("sample_a", "sample_b"), F.greatest("sample_a", "sample_b")
        keyed = pairs.select(
            *[F.floor(c / tile).cast("long").alias(t) for t, c in (("a", low), ("b", high))],
            *[(c % tile).cast("int").alias(t) for t, c in (("i", low), ("j", high))],
            (F.col("distance") * F.col("distance")).alias("d2"),
        )

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.full((tile, tile), np.nan)
            m[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["d2"].to_numpy()
            return pd.DataFrame([[*key, m.tobytes()]], columns=["a", "b", "m"])

        return cls(cut_lineage(keyed.groupBy("a", "b").applyInPandas(build, "a bigint, b bigint, m binary")), tile)

    @contextmanager
    def ready(self, n: int) -> Iterator[Times]:
        """Products with matrices of ``n`` lines; a task adds up its tiles, so it sends back each line once."""
        yield self._times

    def _times(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent, tile, n = self.tiles.sparkSession.sparkContext.broadcast(x), self.tile, len(x)

        def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, there = {}, {}
            for pdf in frames:
                for r in pdf.itertuples():
                    m = np.frombuffer(r.m, dtype=np.float64).reshape(tile, tile)
                    for mine, other, part in ((r.a, r.b, m), (r.b, r.a, m.T)):
                        lines = sent.value[other * tile : min(n, (other + 1) * tile)]
                        known = ~np.isnan(part[:, : len(lines)])
                        sums[mine] = sums.get(mine, 0.0) + np.where(known, part[:, : len(lines)], 0.0) @ lines
                        there[mine] = there.get(mine, False) | known.any(axis=1)
            for t, m in sums.items():
                at = np.flatnonzero(there[t])
                yield pd.DataFrame([[(t * tile + at).astype(np.int64).tobytes(), m[at].tobytes()]], columns=["ids", "m"])

        out = _added(self.tiles.select("a", "b", "m").mapInPandas(multiply, "ids binary, m binary"), x)
        sent.destroy()
        return out


# --- points in feature space --------------------------------------------------------------


def cluster_separation(points: DataFrame, tile: int = POINT_TILE) -> DataFrame:
    """Smallest distance between and largest distance within clusters: ``(min_between, max_within, pairs, compared)``.

    ``points`` are ``(id, features array, cluster)``; see ``balls.separation``.
    """
    return balls.separation(points, tile)


def nearest_neighbours(
    queries: DataFrame, points: DataFrame, k: int, tile: int = POINT_TILE, exclude_self: bool = False
) -> DataFrame:
    """The ``k`` nearest points of every query: ``(query_id, rank, id, label, distance)``, exact.

    Both sides are ``(id, features array[, label])``. Equal distances go by id. See ``balls.nearest_in_balls``.
    """
    return balls.nearest_in_balls(queries, points, k, tile, exclude_self)[0]


def as_points(df: DataFrame, id_col: str, vector: str, **columns: str) -> DataFrame:
    """``(id, features array, ...)`` from a table with a vector or array column."""
    dtype = df.schema[vector].dataType.simpleString()
    values = vector_to_array(vector) if dtype == "vector" else F.col(vector).cast("array<double>")
    return df.select(
        F.col(id_col).alias("id"), values.alias("features"), *[F.col(c).alias(n) for n, c in columns.items()]
    )
