"""Dosage matrices cut into fixed-size tiles, for pairwise work as matrix products.

Two numbered axes: the *paired* axis (variants for linkage, samples for distances) is cut into
tiles of ``tile`` entries, the *counted* axis into blocks. A tile travels as one binary value, so
comparing two tiles moves tile-sized bytes rather than one row per pair and observation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -1


def dosage_tiles(
    cells: DataFrame,
    paired: str,
    counted: str,
    tile: int,
    block: int,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Long ``(paired, counted, dosage)`` to ``(*extra, tile, block, ids, width, data)``.

    ``extra`` columns depend on the paired key alone (such as its contig) and split tiles. A group holds at most ``tile * block``
    cells whatever the data look like. Dosages outside 0..2 count as missing.
    """
    keyed = cells.filter(F.col("dosage").between(0, 2)).select(
        *extra,
        F.floor(F.col(paired) / tile).cast("long").alias("tile"),
        F.floor(F.col(counted) / block).cast("long").alias("block"),
        F.col(paired).cast("long").alias("_p"),
        (F.col(counted) % block).cast("int").alias("_c"),
        F.col("dosage").cast("byte").alias("_d"),
    )
    names = [*extra, "tile", "block"]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(pdf["_p"].to_numpy(), return_inverse=True)
        col = pdf["_c"].to_numpy()
        width = int(col.max()) + 1
        m = np.full((len(ids), width), MISSING, dtype=np.int8)
        m[row, col] = pdf["_d"].to_numpy()
        return pd.DataFrame(
            [[*key, ids.tolist(), width, m.tobytes()]], columns=[*names, "ids", "width", "data"]
        )

    types = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    return keyed.groupBy(*names).applyInPandas(build, f"{schema}, ids array<bigint>, width int, data binary")


def spread_tile(rows: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    """Int8 matrix with one line per listed id; ids without a call in the block are all missing."""
    if not len(rows):
        return np.full((len(ids), 0), MISSING, dtype=np.int8)
    row = rows.iloc[0]
    have = np.asarray(row["ids"], dtype=np.int64)
    width = int(row["width"])
    out = np.full((len(ids), width), MISSING, dtype=np.int8)
    out[np.searchsorted(ids, have)] = np.frombuffer(row["data"], dtype=np.int8).reshape(len(have), width)
    return out


def joint_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3 x 3 x len(a) x len(b) joint dosage counts from one product of indicator matrices."""
    w = min(a.shape[1], b.shape[1])  # beyond the shorter one every observation lacks a partner
    dosages = np.arange(3, dtype=np.int8)[:, None, None]
    ia = (a[None, :, :w] == dosages).reshape(3 * len(a), w).astype(np.float32)
    ib = (b[None, :, :w] == dosages).reshape(3 * len(b), w).astype(np.float32)
    return (ia @ ib.T).reshape(3, len(a), 3, len(b)).transpose(0, 2, 1, 3)


def difference_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """len(a) x len(b) counts of the observations called in both, and of those whose dosages differ by one and by two."""
    w = min(a.shape[1], b.shape[1])
    (a0, a1, a2), (b0, b1, b2) = (((m[None, :, :w] == np.arange(3, dtype=np.int8)[:, None, None]).astype(np.float32)) for m in (a, b))
    valid = (a0 + a1 + a2) @ (b0 + b1 + b2).T
    one = np.concatenate([a1, a0 + a2], axis=1) @ np.concatenate([b0 + b2, b1], axis=1).T
    two = np.concatenate([a0, a2], axis=1) @ np.concatenate([b2, b0], axis=1).T
    return valid, one, two


def pair_tiles(tiles: DataFrame, pairs: DataFrame, keys: tuple[str, ...], kernel, schema: str) -> DataFrame:
    """Runs ``kernel(key, left, right)`` for every listed pair of tiles.

    ``pairs`` has ``keys`` plus ``tile_a`` and ``tile_b``. Each side is fanned out to its pairs and
    meets its partner in a co-group of exactly one row per side and block.
    """
    on = list(keys)
    left = tiles.withColumnRenamed("tile", "tile_a").join(pairs, [*on, "tile_a"])
    right = tiles.withColumnRenamed("tile", "tile_b").join(pairs, [*on, "tile_b"])
    return meet(left, right, [*on, "tile_a", "tile_b", "block"], kernel, schema)


def meet(left: DataFrame, right: DataFrame, group: list[str], kernel, schema: str) -> DataFrame:
    """Co-groups two tables that share an origin (one side is renamed apart for the analyser)."""
    apart = right.toDF(*right.columns)
    return left.groupBy(*group).cogroup(apart.groupBy(*group)).applyInPandas(kernel, schema)
