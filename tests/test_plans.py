import numpy as np
import pytest

from demescope.operators import cluster, ld, reduce
from demescope.operators.contingency import agreement, confusion
from demescope.plans import quality, stratify, tuning
from registry import cohort as derived

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cohort(spark, cells):
    df, _ = cells
    panel = spark.createDataFrame([(f"s{i:02d}", "AB"[i % 2]) for i in range(60)], "sample_id string, region string")
    return quality.Cohort.of(df.drop("snp_idx", "sample_no"), panel)


@pytest.mark.parametrize("rate", [1.0, 0.1])
def test_shared_tuner_equals_cell_by_cell(cohort, rate):
    maf, ld_set, npc = ((0.05, 0.51), (0.2, 0.5)), (0.4,), (2, 3)
    found = tuning.tune_maf_ld_npc(cohort, maf, ld_set, npc, max_bp=5000, n_clusters=2, missing_rate=rate)
    got = {(r["min_maf"], r["ld"], r["npc"]): r["ari"] for r in found.scores.collect()}
    assert len(got) == 4
    for low, high in maf:
        for threshold in ld_set:
            snps = cohort.chosen(low, high, rate)
            pairs = ld.ld_pairs(cohort.restrict(snps), "composite", 5000)
            kept = cohort.restrict(ld.ld_prune(pairs, snps, threshold))
            for k in npc:
                scores, _ = reduce.sample_pca(kept, k)  # every cell on its own
                ward = cluster.ward(reduce.labelled(scores, cohort.regions), 2)
                want = round(agreement(confusion(ward, "region", "prediction")).first()["ari"], 2)
                assert got[(low, threshold, k)] == want
    top = max(got.values())
    assert found.best["ari"] == top
    wide = tuning.cross_table(found.scores.filter("min_maf = 0.05"), ["ld"], "npc", "ari")
    assert wide.columns == ["ld", "2", "3"] and wide.count() == 1


def test_gap_rule_walks_in_order(spark):
    rows = [(i, 0.0, 1.0, 0.2, k, "x", tr, te) for i, (k, tr, te) in enumerate([(2, 30.0, 60.0), (3, 40.0, 50.0), (4, 5.0, 30.0), (5, 20.0, 28.0), (6, 39.0, 45.0)])]
    df = spark.createDataFrame(rows, "cell int, min_maf double, max_maf double, ld double, npc int, algorithm string, train_error double, test_error double")
    best = tuning.best_by_gap(df)
    # gaps 30, 10, 25, 8, 6 against 100: cells 0, 1 and 3 are taken; cell 4 has the narrowest gap but no lower error.
    assert (best["npc"], best["train_error"], best["test_error"]) == (5, 20.0, 28.0)
    assert tuning.best_by_gap(df, 100.0, 100.0)["npc"] == 2


def test_cohort_selection_and_exports(spark, cohort, tmp_path):
    panel = quality.snp_panel(cohort, 0.05, 0.51, 0.5, max_bp=5000, path=str(tmp_path / "snps"))
    n = panel.count()
    assert 0 < n < 40
    assert spark.read.csv(str(tmp_path / "snps"), header=True).count() == n
    matrix = quality.qc_matrix(cohort, min_maf=0.05, max_maf=0.51, ld=0.5, max_bp=5000)
    assert matrix.first()["features"].size == n and matrix.count() == 60
    quality.qc_subset(cohort, str(tmp_path / "subset"), min_maf=0.05, max_maf=0.51, ld=0.5, max_bp=5000)
    assert spark.read.parquet(str(tmp_path / "subset")).select("contig", "pos").distinct().count() == n
    scores, table = quality.qc_pca(cohort, 3, min_maf=0.05, max_maf=0.51, ld=0.5, max_bp=5000)
    assert scores.count() == 60 and table.count() == 3


def test_whole_study(spark):
    done = stratify.stratify(
        derived.calls(spark, SF), derived.regions(spark, SF), missing_rate=0.5, min_freq=0.1, ld_max_bp=5000,
        npc=4, clustering="kmeans", n_clusters=3, classification="dt", repeats=1, find_outliers=True,
    )
    assert done.cluster_metrics.count() == 1 and done.samples.count() == 10 - done.outliers.count()
    assert {"linkage", "reduction", "clustering"} <= {r["stage"] for r in done.timings().collect()}
    assert done.class_metrics.count() >= 1


def test_population_matrix(spark):
    p = stratify.Population(derived.calls(spark, SF), derived.regions(spark, SF)).with_carriers(0.2, 0.9, 0.4)
    m = p.matrix()
    assert m.count() == 10
    assert m.first()["features"].size == p.long().select("contig", "pos", "ref_allele", "alt_allele").distinct().count()
    assert np.isfinite(m.first()["features"].toArray()).all()
