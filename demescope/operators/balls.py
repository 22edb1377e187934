"""Points in balls around pivots, and exact searches that leave out balls by their bounds.

Every point goes to its nearest pivot. A ball is known by its pivot, its radius and its size, so two balls have a
least and a greatest possible distance between their points. There are at most ``MAX_PIVOTS`` pivots whatever the
number of points. Neighbouring balls travel together in chunks of bounded size (a large ball is cut by a hash of the id),
and inside a pair of chunks only balls that can still matter are compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demescope.operators.tiles import meet
from demescope.session import cut_lineage

TILE, MAX_PIVOTS = 1024, 1024
#: Pairs of balls in the first wave of a best-first comparison; each wave after it doubles.
FIRST_WAVE = 64
#: Waves before all pairs left are taken at once, and points in a chunk at most.
WAVES, MAX_CHUNK = 3, 32_768


def euclidean_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the lines of two matrices, by differences (exact for equal points)."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for s in range(0, len(a), step):
        d = a[s : s + step, None, :] - b[None, :, :]
        out[s : s + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


#: Columns of which only the least distance is looked at first, and pairs whose exact distance is taken at a time.
GROUP, EXACT_PAIRS = 32, 65_536


class Rough:
    """Squared distances of the lines of two matrices from one product in single precision, each within ``slack`` of the exact one.

    Both are moved to the mean of ``b`` and scaled to at most 1 (so are the distances). ``of`` is None where a number isn't finite.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, centre = a, b, b.mean(axis=0)
        a, b = a - centre, b - centre
        self.scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) or 1.0
        x, y = (a / self.scale).astype(np.float32), (b / self.scale).astype(np.float32)
        xx, yy = (np.square(z, dtype=np.float64).sum(axis=1)[:, None] for z in (x, y))
        ones = (np.ones((len(z), 1)) for z in (x, y))
        self.left = np.concatenate([x, next(ones), xx], axis=1, dtype=np.float32)
        self.right = np.concatenate([-2 * y, yy, next(ones)], axis=1, dtype=np.float32)
        self.slack = (x.shape[1] + 32) * 1.2e-7 * (np.sqrt(xx.max(initial=0.0)) + np.sqrt(yy.max(initial=0.0))) ** 2 + 1e-30

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Rough | None:
        with np.errstate(all="ignore"):
            rough = cls(a, b)
        return rough if np.isfinite(rough.scale) and 1e-140 < rough.scale < 1e140 else None

    def block(self, rows: slice) -> np.ndarray:
        return self.left[rows] @ self.right.T

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distances of the named pairs, by differences."""
        out = np.empty(len(rows))
        for s in range(0, len(rows), EXACT_PAIRS):
            d = self.a[rows[s : s + EXACT_PAIRS]] - self.b[cols[s : s + EXACT_PAIRS]]
            out[s : s + EXACT_PAIRS] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """For each line a bound that ``k`` of its entries don't exceed: the k-th of the least entries of groups of columns."""
    whole = d.shape[1] // GROUP
    if whole <= k:
        return np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
    least = d[:, : whole * GROUP].reshape(len(d), whole, GROUP).min(axis=2)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def matrix_of(values: Sequence) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in values])


def choose_pivots(points: DataFrame, tile: int, most: int = MAX_PIVOTS) -> np.ndarray:
    """Features of the points with the smallest hashes of their ids, about one for each ``tile`` points."""
    n = points.count()
    rows = points.orderBy(F.xxhash64("id"), "id").select("features").limit(int(min(most, max(1, -(-n // tile))))).collect()
    return matrix_of([r["features"] for r in rows])


def in_balls(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The points with ``ball``, the number of the nearest pivot, and ``gap``, the distance to it; written out."""

    @F.pandas_udf("ball int, gap double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        if not len(features):
            return pd.DataFrame({"ball": np.zeros(0, np.int32), "gap": np.zeros(0)})
        x = matrix_of(features)
        step = max(1, 1_000_000 // len(pivots))
        parts = [euclidean_block(x[s : s + step], pivots) for s in range(0, len(x), step)]
        ball = np.concatenate([d.argmin(axis=1) for d in parts])
        return pd.DataFrame({"ball": ball.astype(np.int32), "gap": np.concatenate([d.min(axis=1) for d in parts])})

    return cut_lineage(points.withColumn("_n", nearest("features")).select("*", "_n.ball", "_n.gap").drop("_n"))


def _chunked(sizes: Sequence[int], order: Sequence[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first chunk and the number of chunks of each ball: small balls share one, large ones are cut."""
    first, parts, chunk, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, most
    for ball in order:
        n = sizes[ball]
        if held + n > most:
            chunk, held = chunk + 1, 0
        first[ball], parts[ball], held = chunk, max(1, -(-n // most)), held + n
        chunk += parts[ball] - 1
    return first, parts


def _neighbouring(pivots: np.ndarray) -> np.ndarray:
    """An order of pivots in which those near the same few leaders follow each other."""
    leaders = pivots[: max(1, int(np.sqrt(len(pivots))))]
    d = euclidean_block(pivots, leaders)
    return np.lexsort((d.min(axis=1), d.argmin(axis=1)))


def chunk_size(n: int, tile: int) -> int:
    """Points in a chunk: an eighth of them, between ``tile`` and ``MAX_CHUNK``, so chunks are few but bounded."""
    return int(min(MAX_CHUNK, max(tile, -(-n // 8)))) if tile >= TILE else tile


@dataclass
class Chunks:
    """``chunk, points``: whole balls, or parts of a large one by a hash of the id, and where each ball number went."""

    table: DataFrame
    first: np.ndarray
    parts: np.ndarray


def in_chunks(rows: DataFrame, sizes: Sequence[int], order: Sequence[int], most: int, columns: Sequence[str]) -> Chunks:
    """``rows`` have a ball ``number``; written out."""
    first, parts = _chunked(sizes, order, most)
    where = [(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts, strict=True))]
    named = rows.join(rows.sparkSession.createDataFrame(where, "number int, _first long, _parts long"), "number")
    chunk = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))
    table = named.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("id", "number", "features", *columns)).alias("_p"))
    cells = [F.col(f"_p.{c}").alias(c) for c in ("id", "number", *columns)]
    return Chunks(cut_lineage(table.select("chunk", *cells, F.flatten("_p.features").alias("x"))), first, parts)


def compare(left: Chunks, right: Chunks, near: np.ndarray, kernel, schema: str, half: bool = False) -> DataFrame:
    """``kernel(a, b, near)`` for every pair of chunks with a pair of balls marked in ``near``; each side's columns as arrays.

    Points travel once for each partner of their chunk, not of their ball. ``half`` takes a pair of chunks of one table once.
    """
    spark = left.table.sparkSession
    i, j = np.nonzero(near)
    found = [np.zeros((0, 2), np.int64)]
    for p in range(int(left.parts.max())):
        for q in range(int(right.parts.max())):
            ok = (p < left.parts[i]) & (q < right.parts[j])
            found.append(np.unique(np.stack([left.first[i[ok]] + p, right.first[j[ok]] + q], axis=1), axis=0))
    pairs = np.concatenate(found)
    pairs = np.unique(np.sort(pairs, axis=1) if half else pairs, axis=0)
    listed = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long")

    def side(row) -> dict:
        out = {c: np.asarray(row[c]) for c in row.index if c not in ("a", "b", "chunk", "x")}
        return out | {"x": np.asarray(row["x"], dtype=np.float64).reshape(len(out["id"]), -1)}

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):  # a hash left a part of a ball empty
            return pd.DataFrame()
        return kernel(side(x.iloc[0]), side(y.iloc[0]), near)

    one = left.table.withColumnRenamed("chunk", "a").join(listed, "a")
    two = right.table.withColumnRenamed("chunk", "b").join(listed, "b")
    return meet(one, two, ["a", "b"], run, schema)


# --- nearest neighbours -------------------------------------------------------------------


def _kernel(k: int, exclude_self: bool):
    """Per query the ``k`` nearest of one chunk's balls marked near, no farther than the query's own ``reach``."""

    def nearest(a: dict, b: dict, near: np.ndarray) -> pd.DataFrame:
        out = {"query_id": a["id"][:0], "id": b["id"][:0], "label": b["label"][:0], "distance": np.zeros(0)}
        frames = [pd.DataFrame(out)]
        reach = np.array([np.inf if r is None or np.isnan(r) else r for r in a["reach"]])
        for ball in np.unique(a["number"]):
            mine, theirs = np.flatnonzero(a["number"] == ball), np.flatnonzero(near[ball, b["number"]])
            if not len(theirs):
                continue
            y, iy, label = b["x"][theirs], b["id"][theirs], b["label"][theirs]
            step = max(1, 4_000_000 // len(theirs))
            rough = Rough.of(a["x"][mine], y)
            own = exclude_self and np.isin(iy, a["id"][mine]).any()
            for s in range(0, len(mine), step):
                some = mine[s : s + step]
                if rough is None:
                    d = euclidean_block(a["x"][some], y)
                    rows, cols = np.nonzero((d <= reach[some][:, None]) & np.isfinite(d))
                    gap = d[rows, cols]
                else:
                    d = rough.block(slice(s, s + step))
                    if own:
                        d[a["id"][some][:, None] == iy[None, :]] = np.inf
                    # Whatever is nearer than this roughly may be among the k nearest; the others can't.
                    with np.errstate(over="ignore"):
                        last = np.minimum(_least(d, k), (reach[some] / rough.scale) ** 2) + 2 * rough.slack
                    rows, cols = np.nonzero((d <= last[:, None]) & np.isfinite(d))
                    gap = rough.exact(s + rows, cols)
                keep = (gap <= reach[some][rows]) & np.isfinite(gap)
                if exclude_self:
                    keep &= a["id"][some][rows] != iy[cols]
                rows, cols, gap = rows[keep], cols[keep], gap[keep]
                order = np.lexsort((iy[cols], gap, rows))
                rows, cols, gap = rows[order], cols[order], gap[order]
                first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                rows, cols, gap = rows[first], cols[first], gap[first]
                frames.append(pd.DataFrame({"query_id": a["id"][some][rows], "id": iy[cols], "label": label[cols], "distance": gap}))
        found = pd.concat(frames[1:] or frames, ignore_index=True)
        if len(frames) < 3:
            return found
        return found.sort_values(["query_id", "distance", "id"]).groupby("query_id", sort=False).head(k)

    return nearest


def nearest_in_balls(queries: DataFrame, points: DataFrame, k: int, tile: int = TILE, exclude_self: bool = False) -> tuple[DataFrame, int, int]:
    """``(query_id, rank, id, label, distance)``, the pairs of balls there are and those compared.

    Queries first meet the points of their own ball; the farthest of the ``k`` found there is a query's reach. Then a
    ball of queries meets those balls whose least distance is within the reach of one of its queries.
    """
    pivots = choose_pivots(points, tile)
    kinds = [queries.schema["id"].dataType.simpleString(), points.schema["id"].dataType.simpleString(), points.schema["label"].dataType.simpleString()]
    schema = "query_id {}, id {}, label {}, distance double".format(*kinds)
    placed = in_balls(points.select("id", "features", "label"), pivots) if len(pivots) else None
    if placed is None:
        return points.sparkSession.createDataFrame([], schema).selectExpr("query_id", "1 as rank", "id", "label", "distance"), 0, 0
    asked = in_balls(queries.select("id", "features"), pivots)
    balls = placed.groupBy("ball").agg(F.max("gap").alias("r"), F.count("*").alias("n")).collect()  # one row a pivot at most
    held = {r["ball"]: r for r in balls}
    sizes = np.array([held[p]["n"] if p in held else 0 for p in range(len(pivots))])
    radius = np.array([held[p]["r"] if p in held else -np.inf for p in range(len(pivots))])
    order, most = _neighbouring(pivots), chunk_size(int(sizes.sum()), tile)
    there = in_chunks(placed.withColumnRenamed("ball", "number"), sizes, order, most, ["label"])
    kernel = _kernel(k, exclude_self)
    best = Window.partitionBy("query_id").orderBy("distance", "id")

    def asking(rows: DataFrame) -> Chunks:
        per = {r["ball"]: r["count"] for r in rows.groupBy("ball").count().collect()}
        return in_chunks(rows.withColumnRenamed("ball", "number"), [per.get(p, 0) for p in range(len(pivots))], order, most, ["reach"])

    def top(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    blind = asking(asked.withColumn("reach", F.lit(None).cast("double")))
    first = cut_lineage(top(compare(blind, there, np.diag(sizes > 0), kernel, schema)).drop("rank"))
    reach = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
    told = cut_lineage(asked.join(reach, "id", "left"))
    far = told.groupBy("ball").agg(F.max("gap").alias("r"), F.max(F.coalesce("reach", F.lit(float("inf")))).alias("reach")).collect()
    # Rounding must not lose a neighbour at the very edge.
    near = np.zeros((len(pivots), len(pivots)), dtype=bool)
    for q in far:
        gap = euclidean_block(pivots[[q["ball"]]], pivots)[0]
        near[q["ball"]] = (sizes > 0) & (gap - q["r"] - radius <= q["reach"] * (1 + 1e-9) + 1e-12)
        near[q["ball"], q["ball"]] = False
    pairs = int(near.sum())
    found = top(first.unionByName(compare(asking(told), there, near, kernel, schema))) if pairs else top(first)
    return found.select("query_id", "rank", "id", "label", "distance"), len(far) * len(balls), pairs + len(balls)


# --- separation of clusters ---------------------------------------------------------------


def separation(points: DataFrame, tile: int = TILE) -> DataFrame:
    """``(min_between, max_within, pairs, compared)``: the smallest distance between clusters, the largest within one.

    ``points`` are ``(id, features array, cluster)``. A ball holds points of one cluster. Pairs of balls are taken in
    waves, those of least possible distance between clusters and of greatest possible one within first, until no
    pair left can change either number. ``pairs`` counts the pairs of balls, ``compared`` those looked into.
    """
    spark = points.sparkSession
    clusters = max(1, points.select("cluster").distinct().count())
    pivots = choose_pivots(points, tile, max(8, 4 * MAX_PIVOTS // clusters))
    schema = "min_between double, max_within double, pairs long, compared long"
    if not len(pivots):
        return spark.createDataFrame([(None, None, 0, 0)], schema)
    placed = in_balls(points.select("id", "features", "cluster"), pivots)
    balls = placed.groupBy("ball", "cluster").agg(F.max("gap").alias("r"), F.count("*").alias("n")).orderBy("ball", "cluster").collect()
    names = spark.createDataFrame([(i, b["ball"], b["cluster"]) for i, b in enumerate(balls)], f"number int, ball int, cluster {placed.schema['cluster'].dataType.simpleString()}")
    named = placed.join(names, placed["ball"].eqNullSafe(names["ball"]) & placed["cluster"].eqNullSafe(names["cluster"])).select("number", "id", "features")
    sizes, r = np.array([b["n"] for b in balls]), np.array([b["r"] for b in balls])
    place = np.argsort(_neighbouring(pivots))
    order = np.argsort([place[b["ball"]] for b in balls], kind="stable")
    chunks = in_chunks(named, sizes, order, chunk_size(int(sizes.sum()), tile), [])
    i, j = np.triu_indices(len(balls))
    centre = pivots[[b["ball"] for b in balls]]
    group = np.unique([str(b["cluster"]) for b in balls], return_inverse=True)[1]
    d = np.concatenate([euclidean_block(centre[[a]], centre[a:])[0] for a in range(len(balls))])
    low, high = np.maximum(d - r[i] - r[j], 0) * (1 - 1e-9), (d + r[i] + r[j]) * (1 + 1e-9)
    within = group[i] == group[j]

    def look(a: dict, b: dict, near: np.ndarray) -> pd.DataFrame:
        least, most = np.inf, -np.inf
        for ball in np.unique(a["number"]):
            mine, marked = np.flatnonzero(a["number"] == ball), near[ball, b["number"]] | near[b["number"], ball]
            for same in (False, True):
                theirs = np.flatnonzero(marked & ((group[b["number"]] == group[ball]) == same))
                if not len(theirs):
                    continue
                step = max(1, 4_000_000 // len(theirs))
                y, iy = b["x"][theirs], b["id"][theirs]
                rough = Rough.of(a["x"][mine], y)
                own = same and np.isin(iy, a["id"][mine]).any()
                for s in range(0, len(mine), step):
                    some = mine[s : s + step]
                    alike = a["id"][some][:, None] == iy[None, :] if own else np.zeros((1, 1), dtype=bool)
                    if rough is None:
                        gaps = euclidean_block(a["x"][some], y)
                        gaps = gaps[np.broadcast_to(~alike, gaps.shape)]
                    else:
                        # Only pairs that may be the extreme one, as far as the rough distances tell, are looked at closely.
                        d = rough.block(slice(s, s + step))
                        if own:
                            d[alike] = -np.inf
                        if same:
                            bar = max(d.max() - 2 * rough.slack, (max(most, 0.0) / rough.scale) ** 2 - rough.slack)
                            rows, cols = np.nonzero((d >= bar) & np.isfinite(d))
                        else:
                            rows, cols = np.nonzero(d <= min(d.min() + 2 * rough.slack, (least / rough.scale) ** 2 + rough.slack))
                        gaps = rough.exact(s + rows, cols)
                    if gaps.size:
                        least, most = (least, max(most, gaps.max())) if same else (min(least, gaps.min()), most)
        return pd.DataFrame({"between": [least if np.isfinite(least) else None], "within": [most if np.isfinite(most) else None]}, dtype=object)

    least, most, wave = np.inf, -np.inf, FIRST_WAVE
    # Most promising first: closest balls of two clusters and widest balls of one, in turn; after WAVES all that are left.
    left = np.arange(len(i))
    compared = 0
    for turn in range(WAVES + 1):
        left = left[np.where(within[left], high[left] > most, low[left] < least)]
        if not len(left):
            break
        inner, outer = left[within[left]], left[~within[left]]
        some = wave if turn < WAVES else len(left)
        now = np.concatenate([inner[np.argsort(-high[inner], kind="stable")[:some]], outer[np.argsort(low[outer], kind="stable")[:some]]])
        near = np.zeros((len(balls), len(balls)), dtype=bool)
        near[i[now], j[now]] = True
        got = compare(chunks, chunks, near, look, "between double, within double", half=True).agg(F.min("between"), F.max("within")).first()
        least = least if got[0] is None else min(least, got[0])
        most = most if got[1] is None else max(most, got[1])
        compared += len(now)
        left = np.setdiff1d(left, now, assume_unique=True)
        wave *= 2
    row = (float(least) if np.isfinite(least) else None, float(most) if np.isfinite(most) else None, len(i), compared)
    return spark.createDataFrame([row], schema)
