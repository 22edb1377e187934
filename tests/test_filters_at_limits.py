"""Completeness exactly at its limit, and sites whose alternates differ in frequency."""

import pytest

from demescope.operators import qc
from demescope.plans.quality import Cohort
from demescope.plans.stratify import stratify

CELLS = "sample_id string, contig string, pos bigint, ref_allele string, alt_allele string, dosage int"


@pytest.mark.parametrize("samples,calls,rate", [(10, 3, 0.7), (10, 7, 0.3), (10, 9, 0.1), (1000, 300, 0.7), (20, 1, 0.95)])
def test_a_variant_at_the_missing_limit_stays(spark, samples, calls, rate):
    rows = [(f"s{k}", "1", 100, "A", "C", k % 2) for k in range(calls)] + [(f"s{k}", "1", 200, "A", "C", k % 2) for k in range(samples)]
    rows += [(f"s{k}", "1", 300, "A", "C", k % 2) for k in range(calls - 1)]
    cells = spark.createDataFrame(rows, CELLS)
    kept = qc.complete(qc.variant_summary(cells, samples, snv_only=False), samples, rate)
    assert sorted(r["pos"] for r in kept.collect()) == [100, 200]
    regions = cells.select("sample_id").distinct().selectExpr("sample_id", "'r' as region")
    chosen = Cohort.of(cells, regions).chosen(0.0, 1.0, rate, "inclusive")
    assert sorted(r["pos"] for r in chosen.collect()) == [100, 200]


def test_a_site_with_a_rare_second_alternate_is_not_biallelic(spark):
    rows = []
    for k in range(20):
        rows.append((f"s{k:02d}", "1", 100, "A", "C", ["Alt", "Ref"], 1))
        rows.append((f"s{k:02d}", "1", 100, "A", "G", ["Alt", "Ref"] if k == 0 else ["Ref", "Ref"], int(k == 0)))
        rows.append((f"s{k:02d}", "1", 900, "A", "T", ["Alt", "Ref"] if k % 2 else ["Ref", "Ref"], k % 2))
    calls = spark.createDataFrame(rows, "sample_id string, contig string, pos bigint, ref_allele string, alt_allele string, alleles array<string>, dosage int")
    panel = calls.select("sample_id").distinct().selectExpr("sample_id", "'r' as region")
    study = stratify(calls, panel, min_freq=0.2, max_freq=2.0, prune=False, reduction=None, clustering=None)
    assert [r["pos"] for r in study.variants.collect()] == [900]
