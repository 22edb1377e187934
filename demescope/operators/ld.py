"""Linkage disequilibrium in a sliding window, and pruning of correlated variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.functions.ld_measures import CELLS, with_ld
from demescope.operators.reshape import sample_index, snp_index
from demescope.operators.tiles import dosage_tiles, joint_counts, pair_tiles, spread_tile
from demescope.schema import VARIANT
from demescope.session import cut_lineage

SNP_TILE = 128
SAMPLE_BLOCK = 16_384
MIN_BIN_BP = 1_000_000
SEGMENT_SNPS = 4096
SEGMENT_EDGES = 500_000


def number_cells(
    dosages: DataFrame, variants: DataFrame | None = None, samples: DataFrame | None = None
) -> DataFrame:
    """Adds ``snp_idx`` (order of contig, position, alleles) and ``sample_no`` to long dosages.

    ``variants`` / ``samples`` restrict and number the two axes; by default all that occur.
    """
    listed = dosages.select(*VARIANT).distinct() if variants is None else variants.select(*VARIANT)
    people = dosages if samples is None else samples
    return dosages.join(snp_index(listed), VARIANT).join(sample_index(people), "sample_id")


def snp_positions(cells: DataFrame) -> DataFrame:
    """``(contig, snp_idx, pos)`` of numbered dosages."""
    return cells.select("contig", "snp_idx", "pos").distinct()


# --- pairs in a window -------------------------------------------------------------------


def window_pairs(snps: DataFrame, max_bp: int, max_n: int | None = None) -> DataFrame:
    """Ordered pairs of variants of a contig at most ``max_bp`` bases and ``max_n`` indexes apart.

    An interval self-join as an equi-join: the later variant sits in the bin of its position, the
    earlier one is listed in every bin its window reaches, so each pair meets exactly once.
    """
    width = max_bp + 1
    a = snps.select(
        "contig",
        F.col("snp_idx").alias("idx_a"),
        F.col("pos").alias("pos_a"),
        F.explode(
            F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("pos") + max_bp) / width))
        ).alias("bin"),
    )
    b = snps.select(
        "contig",
        F.col("snp_idx").alias("idx_b"),
        F.col("pos").alias("pos_b"),
        F.floor(F.col("pos") / width).alias("bin"),
    )
    near = (F.col("idx_a") < F.col("idx_b")) & (F.col("pos_b") - F.col("pos_a") <= max_bp)
    if max_n is not None:
        near = near & (F.col("idx_b") - F.col("idx_a") <= max_n)
    return a.join(b, ["contig", "bin"]).filter(near).drop("bin")


def _tile_pairs(snps: DataFrame, tile: int, max_bp: int, max_n: int | None) -> DataFrame:
    """Tiles of variants that can hold a pair in the window; works on one row per tile."""
    bounds = snps.groupBy("contig", F.floor(F.col("snp_idx") / tile).cast("long").alias("tile")).agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("snp_idx").alias("first"), F.max("snp_idx").alias("last")
    )
    width = max(max_bp + 1, MIN_BIN_BP)
    a = bounds.select(
        "contig",
        F.col("tile").alias("tile_a"),
        F.col("hi").alias("hi_a"),
        F.col("last").alias("last_a"),
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") + max_bp) / width))).alias("bin"),
    )
    b = bounds.select(
        "contig",
        F.col("tile").alias("tile_b"),
        F.col("lo").alias("lo_b"),
        F.col("first").alias("first_b"),
        F.floor(F.col("lo") / width).alias("bin"),
    )
    reach = (F.col("tile_a") <= F.col("tile_b")) & (F.col("lo_b") - F.col("hi_a") <= max_bp)
    if max_n is not None:
        reach = reach & (F.col("first_b") - F.col("last_a") <= max_n)
    return a.join(b, ["contig", "bin"]).filter(reach).select("contig", "tile_a", "tile_b")


def pair_counts(
    cells: DataFrame,
    max_bp: int = 500_000,
    max_n: int | None = None,
    tile: int = SNP_TILE,
    block: int = SAMPLE_BLOCK,
) -> DataFrame:
    """Joint dosage table of every variant pair in the window: contig, idx_a, idx_b, n00..n22.

    ``cells`` are numbered dosages. Pairs are counted tile against tile and block of samples by
    block, then summed; neither many variants in one window nor many samples grow a task.
    """
    positions = snp_positions(cells)
    tiles = dosage_tiles(cells, "snp_idx", "sample_no", tile, block, extra=("contig",))
    # Every pair of tiles carries the variants of both, so a block of samples in which one tile (or
    # some of its variants) has no call still contributes its pairs, with zero counts.
    spots = positions.groupBy("contig", F.floor(F.col("snp_idx") / tile).cast("long").alias("tile")).agg(
        F.sort_array(F.collect_list(F.struct("snp_idx", "pos"))).alias("s")
    )
    pairs = _tile_pairs(positions, tile, max_bp, max_n)
    for side in ("a", "b"):
        named = spots.select(
            "contig",
            F.col("tile").alias(f"tile_{side}"),
            F.col("s.snp_idx").alias(f"idx_{side}"),
            F.col("s.pos").alias(f"pos_{side}"),
        )
        pairs = pairs.join(named, ["contig", f"tile_{side}"])

    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        about = (left if len(left) else right).iloc[0]
        ids_a, pos_a, ids_b, pos_b = (np.asarray(about[c]) for c in ("idx_a", "pos_a", "idx_b", "pos_b"))
        near = (ids_a[:, None] < ids_b[None, :]) & (pos_b[None, :] - pos_a[:, None] <= max_bp)
        if max_n is not None:
            near &= ids_b[None, :] - ids_a[:, None] <= max_n
        i, j = np.nonzero(near)
        n = joint_counts(spread_tile(left, ids_a), spread_tile(right, ids_b))[:, :, i, j].astype(np.int64)
        out = {"contig": key[0], "idx_a": ids_a[i], "idx_b": ids_b[j]}
        out.update({f"n{x}{y}": n[x, y] for x in range(3) for y in range(3)})
        return pd.DataFrame(out, columns=["contig", "idx_a", "idx_b", *CELLS])

    schema = "contig string, idx_a bigint, idx_b bigint, " + ", ".join(f"{c} bigint" for c in CELLS)
    parts = pair_tiles(tiles, pairs, ("contig",), count, schema)
    return parts.groupBy("contig", "idx_a", "idx_b").agg(*[F.sum(c).alias(c) for c in CELLS])


def ld_pairs(
    cells: DataFrame,
    method: str = "composite",
    max_bp: int = 500_000,
    max_n: int | None = None,
    tile: int = SNP_TILE,
    block: int = SAMPLE_BLOCK,
) -> DataFrame:
    """``(contig, idx_a, idx_b, n_valid, ld)`` of every pair in the window; ``ld`` null if undefined."""
    counts = pair_counts(cells, max_bp, max_n, tile, block)
    total = sum((F.col(c) for c in CELLS[1:]), F.col(CELLS[0]))
    return with_ld(counts, method).select("contig", "idx_a", "idx_b", total.alias("n_valid"), "ld")


# --- pruning -----------------------------------------------------------------------------


def conflict_edges(pairs: DataFrame, threshold: float = 0.2, start_idx: int | None = None, undefined: str = "conflict") -> DataFrame:
    """Pairs that must not both stay, as ``(contig, earlier, later)`` in scan order.

    The scan runs upward from ``start_idx`` and separately downward below it; pairs across
    the start do not conflict. ``undefined='keep'`` lets pairs without a defined ``ld`` pass.
    """
    if undefined not in ("conflict", "keep"):
        raise ValueError("undefined must be 'conflict' or 'keep'")
    fine = F.coalesce(F.abs("ld") <= threshold, F.lit(undefined == "keep"))
    edges = pairs.filter(~fine)
    if start_idx is None:
        return edges.select("contig", F.col("idx_a").alias("earlier"), F.col("idx_b").alias("later"))
    up = F.col("idx_a") >= start_idx
    down = F.col("idx_b") < start_idx
    return edges.filter(up | down).select(
        "contig",
        F.when(up, F.col("idx_a")).otherwise(F.col("idx_b")).alias("earlier"),
        F.when(up, F.col("idx_b")).otherwise(F.col("idx_a")).alias("later"),
    )


def _segments(edges: DataFrame, segment_snps: int, segment_edges: int) -> DataFrame:
    """Adds ``segment``: runs of neighbouring variants with a bounded number of edges each."""
    chunk = F.floor(F.col("later") / segment_snps).cast("long")
    load = edges.groupBy("contig", chunk.alias("chunk")).agg(F.count("*").alias("load"))
    per = F.greatest(F.lit(1), F.floor(F.lit(segment_snps) / F.ceil(F.col("load") / segment_edges)).cast("long"))
    return (
        edges.withColumn("chunk", chunk)
        .join(load, ["contig", "chunk"])
        .withColumn("segment", F.col("chunk") * segment_snps + F.floor((F.col("later") % segment_snps) / per).cast("long"))
        .drop("chunk", "load")
    )


def _sweep(earlier: np.ndarray, later: np.ndarray, known: np.ndarray) -> tuple[dict[int, bool], np.ndarray]:
    """Decisions of one segment in scan order, and which of its edges stay open.

    ``known`` is 1 or 0 for a partner decided elsewhere, -1 if open. Partners of a node are one set of bits, as are
    the nodes kept and those dropped so far. A node left open has open partners only to wait for, so its other
    edges go.
    """
    names, codes = np.unique(np.concatenate([earlier, later]), return_inverse=True)
    left, right = codes[: len(earlier)].tolist(), codes[len(earlier) :].tolist()
    partners: dict[int, int] = {}
    kept = dropped = 0
    for e, n, k in zip(left, right, known.tolist(), strict=True):
        bit = 1 << e
        partners[n] = partners.get(n, 0) | bit
        if k == 1:
            kept |= bit
        elif k == 0:
            dropped |= bit
    # Scan order is away from the start, so a node lies on one side of all its partners.
    down = {n for e, n in zip(left, right, strict=True) if n < e}
    decided: dict[int, bool] = {}
    for n in [*sorted(n for n in partners if n not in down), *sorted(down, reverse=True)]:
        if partners[n] & kept:
            decided[n] = False
            dropped |= 1 << n
        elif not partners[n] & ~dropped:
            decided[n] = True
            kept |= 1 << n
    open_ = np.fromiter((n not in decided and not dropped >> e & 1 for e, n in zip(left, right, strict=True)), bool, len(left))
    return {int(names[n]): s for n, s in decided.items()}, open_


def independent_set(
    edges: DataFrame,
    nodes: DataFrame,
    segment_snps: int = SEGMENT_SNPS,
    segment_edges: int = SEGMENT_EDGES,
) -> DataFrame:
    """Nodes kept by a greedy scan: a node stays if none of its earlier conflicting nodes stayed.

    Decided in rounds. In each, every segment of neighbouring nodes is swept once, as far as what is known about
    nodes elsewhere allows: one kept earlier partner drops a node, all partners dropped keeps it. A round writes its
    decisions and the open frontier: edges between nodes that are both open. Segments double in length from round
    to round, at a bounded number of edges, so that a chain of dependent nodes needs few rounds.
    """
    listed = edges.select("contig", F.col("later").alias("snp_idx")).distinct()
    free = nodes.join(listed, ["contig", "snp_idx"], "left_anti")
    out = [cut_lineage(free.select("contig", "snp_idx", F.lit(True).alias("kept")))]
    fresh, waiting = out[0], edges.select("contig", "earlier", "later")

    def sweep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        earlier, later = pdf["earlier"].to_numpy(np.int64), pdf["later"].to_numpy(np.int64)
        known = pdf["kept"].map({True: 1, False: 0}).fillna(-1).to_numpy(np.int64)
        decided, open_ = _sweep(earlier, later, known)
        settled = pd.DataFrame({"snp_idx": list(decided), "kept": list(decided.values())}, columns=["snp_idx", "kept"])
        frontier = pd.DataFrame({"earlier": earlier[open_], "later": later[open_]})
        both = pd.concat([settled, frontier]).assign(contig=key[0])
        both = both.astype({c: "Int64" for c in ("snp_idx", "earlier", "later")} | {"kept": "boolean"})
        return both[["contig", "snp_idx", "kept", "earlier", "later"]]

    schema = "contig string, snp_idx bigint, kept boolean, earlier bigint, later bigint"
    while True:
        status = fresh.select("contig", F.col("snp_idx").alias("earlier"), "kept")
        told = _segments(waiting, segment_snps, segment_edges).join(status, ["contig", "earlier"], "left")
        swept = cut_lineage(told.groupBy("contig", "segment").applyInPandas(sweep, schema))
        fresh = swept.filter(F.col("kept").isNotNull()).select("contig", "snp_idx", "kept")
        waiting = swept.filter(F.col("earlier").isNotNull()).select("contig", "earlier", "later")
        out.append(fresh)
        if waiting.isEmpty():
            break
        segment_snps *= 2
    kept = out[0]
    for part in out[1:]:
        kept = kept.unionByName(part)
    return kept.filter("kept").select("contig", "snp_idx")


def ld_prune(
    pairs: DataFrame,
    snps: DataFrame,
    threshold: float = 0.2,
    start_idx: int | None = None,
    undefined: str = "conflict",
    segment_snps: int = SEGMENT_SNPS,
    segment_edges: int = SEGMENT_EDGES,
) -> DataFrame:
    """Variants ``(contig, snp_idx)`` left after pruning by pairwise linkage.

    ``pairs`` come from ``ld_pairs`` (whose window applies), ``snps`` list all candidates.
    """
    edges = conflict_edges(pairs, threshold, start_idx, undefined)
    return independent_set(edges, snps.select("contig", "snp_idx"), segment_snps, segment_edges)
