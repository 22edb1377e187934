import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demescope.functions.ld_measures import CELLS, haplotype_dprime, haplotype_r, with_haplotypes, with_ld
from demescope.operators import ld


def brute_counts(matrix, contigs, positions, max_bp, max_n=None):
    out = {}
    for i, j in itertools.combinations(range(matrix.shape[1]), 2):
        if contigs[i] != contigs[j] or positions[j] - positions[i] > max_bp or (max_n is not None and j - i > max_n):
            continue
        both = (matrix[:, i] >= 0) & (matrix[:, j] >= 0)
        x, y = matrix[both, i], matrix[both, j]
        out[(i, j)] = tuple(int(((x == a) & (y == b)).sum()) for a in range(3) for b in range(3))
    return out


CONTIGS = ["1" if v < 25 else "2" for v in range(40)]
POSITIONS = [1000 * (v % 25) + 7 for v in range(40)]


@pytest.mark.parametrize("tile,block,max_bp,max_n", [(128, 16384, 4000, None), (4, 16, 6000, None), (3, 7, 50_000, 5), (8, 60, 0, None)])
def test_pair_counts_match_brute_force(cells, tile, block, max_bp, max_n):
    df, matrix = cells
    got = {
        (r["idx_a"], r["idx_b"]): tuple(r[c] for c in CELLS)
        for r in ld.pair_counts(df, max_bp, max_n, tile, block).collect()
    }
    assert got == brute_counts(matrix, CONTIGS, POSITIONS, max_bp, max_n)


def test_pairs_without_a_common_sample_are_kept(spark):
    rows = [(f"s{s}", s, "1", 10 + v, v, 1) for v, people in ((0, range(0, 4)), (1, range(8, 12))) for s in people]
    df = spark.createDataFrame(rows, "sample_id string, sample_no bigint, contig string, pos bigint, snp_idx bigint, dosage int")
    for tile in (1, 8):
        got = ld.ld_pairs(df, "corr", 100, tile=tile, block=4).collect()
        assert [(r["idx_a"], r["idx_b"], r["n_valid"], r["ld"]) for r in got] == [(0, 1, 0, None)]


def test_window_pairs_match_brute_force(cells):
    df, _ = cells
    for max_bp, max_n in ((3000, None), (9000, 3)):
        got = {(r["idx_a"], r["idx_b"]) for r in ld.window_pairs(ld.snp_positions(df), max_bp, max_n).collect()}
        want = {
            (i, j)
            for i, j in itertools.combinations(range(40), 2)
            if CONTIGS[i] == CONTIGS[j] and POSITIONS[j] - POSITIONS[i] <= max_bp and (max_n is None or j - i <= max_n)
        }
        assert got == want


def tables(spark, rows):
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{c} bigint" for c in CELLS))


def test_composite_equals_correlation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 30, (200, 9)).tolist() + [[0] * 9, [0, 0, 0, 0, 9, 0, 0, 0, 0], [5, 5, 5, 0, 0, 0, 0, 0, 0]]
    df = tables(spark, rows)
    comp = [r["ld"] for r in with_ld(df.coalesce(1), "composite").collect()]
    corr = [r["ld"] for r in with_ld(df.coalesce(1), "corr").collect()]
    for row, a, b in zip(rows, comp, corr):
        x = np.repeat([0, 0, 0, 1, 1, 1, 2, 2, 2], row)
        y = np.repeat([0, 1, 2] * 3, row)
        if len(x) and x.std() > 0 and y.std() > 0:
            want = np.corrcoef(x, y)[0, 1]
            assert abs(a - want) < 1e-9 and abs(b - want) < 1e-9
        else:
            assert a is None and b is None
    with pytest.raises(ValueError):
        with_ld(df, "other")


def em_one(n):
    """The iteration written for one table."""
    n = dict(zip(CELLS, n))
    aa, ab = 2 * n["n22"] + n["n21"] + n["n12"], 2 * n["n20"] + n["n21"] + n["n10"]
    ba, bb = 2 * n["n02"] + n["n01"] + n["n12"], 2 * n["n00"] + n["n01"] + n["n10"]
    counts, dh = [aa, ab, ba, bb], n["n11"]
    total = sum(counts) + 2 * dh
    if total == 0:
        return None
    if dh == 0:
        return [c / total for c in counts]
    p = [(c + 0.01) / (sum(counts) + 0.04) for c in counts]
    eps = 2.0**-52
    ll = sum(c * math.log(q + eps) for c, q in zip(counts, p))
    tol = max(abs(math.sqrt(eps) * ll), eps)
    for _ in range(999):
        f = p[0] * p[3] / (p[0] * p[3] + p[1] * p[2])
        p = [(c + w * dh) / total for c, w in zip(counts, (f, 1 - f, 1 - f, f))]
        new = sum(c * math.log(q + eps) for c, q in zip(counts, p))
        if abs(ll - new) <= tol:
            break
        ll = new
    return p


def test_haplotypes_match_a_plain_iteration(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 12, (80, 9)).tolist()
    rows += [[0, 0, 0, 0, 7, 0, 0, 0, 0], [6, 0, 0, 0, 0, 0, 0, 0, 6], [0, 0, 6, 0, 0, 0, 6, 0, 0], [4, 4, 4, 0, 0, 0, 0, 0, 0], [0] * 9]
    df = with_haplotypes(tables(spark, rows).coalesce(1))
    got = df.select("hap.*", haplotype_r(F.col("hap")).alias("r"), haplotype_dprime(F.col("hap")).alias("d")).collect()
    for row, g in zip(rows, got):
        want = em_one(row)
        if want is None:
            assert g["r"] is None and g["d"] is None
            continue
        assert np.allclose([g["pAA"], g["pAB"], g["pBA"], g["pBB"]], want, atol=1e-12)
        if g["r"] is not None:
            assert -1 - 1e-9 <= g["r"] <= 1 + 1e-9
        if g["d"] is not None:
            assert -1e-9 <= g["d"] <= 1 + 1e-9
    assert abs(got[81]["r"] - 1) < 1e-9 and abs(got[82]["r"] + 1) < 1e-9


def scan(n, edges, start):
    """Greedy scan over plain lists."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept = set()
    for half in (range(start, n), range(start - 1, -1, -1)):
        mine = set()
        for v in half:
            if not near.get(v, set()) & mine:
                mine.add(v)
        kept |= mine
    return kept


@pytest.mark.parametrize("seed,start,segment_snps,segment_edges", [(0, None, 4096, 500_000), (1, 0, 8, 10_000), (2, 33, 5, 3), (3, 60, 16, 20)])
def test_prune_equals_greedy_scan(spark, seed, start, segment_snps, segment_edges):
    rng = np.random.default_rng(seed)
    n = 80
    pairs = [("1", i, j, float(rng.random())) for i, j in itertools.combinations(range(n), 2) if j - i <= 9]
    pairs = [(c, i, j, None if rng.random() < 0.05 else v) for c, i, j, v in pairs]
    df = spark.createDataFrame(pairs, "contig string, idx_a bigint, idx_b bigint, ld double")
    snps = spark.range(n).select(F.lit("1").alias("contig"), F.col("id").alias("snp_idx"))
    kept = {r["snp_idx"] for r in ld.ld_prune(df, snps, 0.7, start, segment_snps=segment_snps, segment_edges=segment_edges).collect()}
    bad = {(i, j) for _, i, j, v in pairs if v is None or abs(v) > 0.7}
    assert kept == scan(n, bad, start or 0)


def test_a_chain_of_dependent_nodes_takes_few_rounds(spark, monkeypatch):
    """Each node conflicts with the next: with segments of 4 nodes the rounds double their reach."""
    written = []
    plain = ld.cut_lineage
    monkeypatch.setattr(ld, "cut_lineage", lambda df: written.append(plain(df)) or written[-1])
    n = 300
    edges = spark.createDataFrame([("1", k, k + 1) for k in range(n - 1)], "contig string, earlier bigint, later bigint")
    nodes = spark.range(n).select(F.lit("1").alias("contig"), F.col("id").alias("snp_idx"))
    kept = {r["snp_idx"] for r in ld.independent_set(edges, nodes, 4, 10_000).collect()}
    assert kept == set(range(0, n, 2))
    frontier = [t.filter("earlier is not null").count() for t in written[1:]]
    assert len(frontier) <= 9 and frontier == sorted(frontier, reverse=True) and frontier[-1] == 0


def test_prune_undefined_can_be_kept(spark):
    df = spark.createDataFrame([("1", 0, 1, None)], "contig string, idx_a bigint, idx_b bigint, ld double")
    snps = spark.createDataFrame([("1", 0), ("1", 1), ("2", 2)], "contig string, snp_idx bigint")
    assert ld.ld_prune(df, snps, 0.2).count() == 2
    assert ld.ld_prune(df, snps, 0.2, undefined="keep").count() == 3
    assert ld.ld_prune(df.limit(0), snps, 0.2).count() == 3


def test_number_cells_orders_variants_and_samples(spark):
    rows = [("b", "1", 20, "A", "C", 1), ("a", "1", 3, "A", "C", 2), ("a", "10", 1, "A", "C", 0), ("b", "1", 3, "A", "G", 1)]
    df = spark.createDataFrame(rows, "sample_id string, contig string, pos bigint, ref_allele string, alt_allele string, dosage int")
    got = {(r["contig"], r["pos"], r["alt_allele"]): r["snp_idx"] for r in ld.number_cells(df).collect()}
    assert got == {("1", 3, "C"): 0, ("1", 3, "G"): 1, ("1", 20, "C"): 2, ("10", 1, "C"): 3}
