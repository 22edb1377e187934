"""End-to-end runs and grid searches on the derived cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from demescope.operators import cluster, qc, reshape
from demescope.plans import quality, stratify, tuning
from demescope.schema import VARIANT
from demescope.session import scratch_path
from demescope.sources import readers, writers
from registry.catalogue import query, r6
from registry.cohort import calls, dosages, regions
from registry.genetics import recursive, scan_sql
from registry.models import components
from registry.tables import SUMMARY, V

MAX_BP = 5000
RANGES = ((0.05, 0.5), (0.1, 0.4))
THRESHOLDS = (0.2, 0.4)


def cohort(spark, sf, level="super_pop"):
    return quality.Cohort.of(dosages(spark, sf), regions(spark, sf, level))


@query("selected_panel")
def selected_panel(spark, sf):
    return quality.snp_panel(cohort(spark, sf), 0.05, 0.5, 0.2, max_bp=MAX_BP).select(*VARIANT, r6("maf").alias("maf"))


@query("selected_cells")
def selected_cells(spark, sf):
    cells = quality.qc_cells(cohort(spark, sf), min_maf=0.05, max_maf=0.5, ld=0.2, max_bp=MAX_BP)
    return cells.select("sample_id", "region", *VARIANT, "dosage")


SELECTED = scan_sql("maf > 0.05 and maf < 0.5")
recursive("selected_panel", f"{SELECTED} select {V}, round(maf, 6) as maf from pruned")
recursive("selected_cells", f"{SELECTED} select sample_id, super_pop as region, {V}, dosage from numbered join pruned using (snp_idx, {V}) join people on sample = sample_id")
recursive("selected_subset", f"{SELECTED} select sample_id, {V}, dosage from numbered join pruned using (snp_idx, {V})")


@query("selected_components")
def selected_components(spark, sf):
    scores, _ = quality.qc_pca(cohort(spark, sf), 4, min_maf=0.05, max_maf=0.5, ld=0.2, max_bp=MAX_BP)
    return reshape.with_components(scores, 4)


@query("selected_subset")
def selected_subset(spark, sf):
    path = scratch_path(spark, "qc")
    quality.qc_subset(cohort(spark, sf), path, min_maf=0.05, max_maf=0.5, ld=0.2, max_bp=MAX_BP)
    return spark.read.schema("sample_id string, pos bigint, ref_allele string, alt_allele string, dosage int, contig string").parquet(path)


@query("panel_matrix", f"""
{SUMMARY}, spots as (select distinct contig, pos from summary where maf > 0.1)
select sample_id, super_pop as region, contig, pos, cast(sum(dosage) as int) as dosage, copy
from calls join spots using (contig, pos) join people on sample = sample_id, (values (1), (2)) c(copy)
where not (a1 = 'OtherAlt' and a2 = 'OtherAlt') group by sample_id, super_pop, contig, pos, copy""")
def panel_matrix(spark, sf):
    rows = calls(spark, sf)
    path = scratch_path(spark, "spots")
    writers.write_snp_panel(reshape.snp_index(qc.variant_summary(rows).filter("maf > 0.1")), path)
    found = quality.matrix_from_panel(rows, readers.read_snp_panel(spark, path), regions(spark, sf), 2)
    return found.select("sample_id", "region", "contig", "pos", "dosage", "copy")


@query("population_long", f"""
, n as (select count(distinct sample_id) as n from calls), f as (
  select {V} from calls, n group by {V}, n having count(*) filter (where dosage > 0) / cast(n as double) between 0.2 and 0.8 and count(*) >= n * (1.0 - 0.3))
select sample_id, super_pop as region, {V}, dosage from calls join f using ({V}) join people on sample = sample_id
where not (a1 = 'OtherAlt' and a2 = 'OtherAlt')""")
def population_long(spark, sf):
    found = stratify.Population(calls(spark, sf), regions(spark, sf)).with_carriers(0.2, 0.8, 0.3).long()
    return found.select("sample_id", "region", *VARIANT, "dosage")


@query("components_and_clusters")
def components_and_clusters(spark, sf):
    vectors = stratify.Population(calls(spark, sf), regions(spark, sf)).with_carriers(0.1, 0.9, 0.3).matrix()
    found, _ = stratify.components_and_clusters(vectors)
    return found.select("sample_id", "region", "prediction")


def study(spark, sf, **options):
    common = {"missing_rate": 0.3, "min_freq": 0.1, "max_freq": 1.0, "ld_max_bp": MAX_BP}
    return stratify.stratify(calls(spark, sf), regions(spark, sf), **{**common, **options})


@query("study_clusters")
def study_clusters(spark, sf):
    return study(spark, sf).cluster_metrics


@query("study_classes")
def study_classes(spark, sf):
    return study(spark, sf, reduction="MDS", mds_metric="manhattan", clustering=None, classification="dt", repeats=2, find_outliers=True).class_metrics


@query("drill_down")
def drill_down(spark, sf):
    """One cluster's samples, relabelled by nation, reduced and clustered again."""
    found = cluster.ward(components(spark, sf), 5)
    members = cluster.cluster_members(found, 0, regions(spark, sf, "pop"))
    inner = quality.Cohort.of(dosages(spark, sf), members)
    scores, _ = quality.qc_pca(inner, 4, min_maf=0.05, max_maf=0.5, ld=0.4, max_bp=MAX_BP)
    return cluster.ward(scores, 3).select("sample_id", "region", "prediction")


def searched(name, run):
    query(name)(lambda spark, sf: run(cohort(spark, sf)).scores.drop("cell"))


_C = {"max_bp": MAX_BP, "missing_rate": 1.0}
_K = {"max_bp": MAX_BP, "missing_rate": 1.0, "trees": 20, "folds": 2}
searched("tune_maf", lambda c: tuning.tune_maf(c, RANGES, **_C))
searched("tune_ld", lambda c: tuning.tune_ld(c, RANGES[0], THRESHOLDS, **_C))
searched("tune_npc", lambda c: tuning.tune_npc(c, RANGES[0], (3, 4), **_C))
searched("tune_ld_maf", lambda c: tuning.tune_ld_maf(c, RANGES, THRESHOLDS, **_C))
searched("tune_maf_npc", lambda c: tuning.tune_maf_npc(c, RANGES, (3, 4), algorithm="kmeans", **_C))
searched("tune_ld_npc", lambda c: tuning.tune_ld_npc(c, RANGES[0], THRESHOLDS, (3, 4), algorithm="em", **_C))
searched("tune_maf_ld_npc", lambda c: tuning.tune_maf_ld_npc(c, RANGES, THRESHOLDS, (3, 4), **_C))
searched("tune_maf_class", lambda c: tuning.tune_maf_class(c, RANGES, algorithms=["dt", "rf"], **_K))
searched("tune_ld_class", lambda c: tuning.tune_ld_class(c, RANGES[0], THRESHOLDS, algorithms=["dt", "rf"], **_K))
searched("tune_npc_class", lambda c: tuning.tune_npc_class(c, RANGES[0], (3, 5), algorithms=["svml", "dt"], **_K))
searched("tune_ld_npc_class", lambda c: tuning.tune_ld_npc_class(c, RANGES[0], THRESHOLDS, (3, 5), "dt", **_K))
searched("tune_maf_npc_class", lambda c: tuning.tune_maf_npc_class(c, RANGES, (3, 5), algorithm="rf", **_K))
searched("tune_maf_ld_class", lambda c: tuning.tune_maf_ld_class(c, RANGES, THRESHOLDS, algorithm="dt", **_K))
searched("tune_maf_ld_npc_class", lambda c: tuning.tune_maf_ld_npc_class(c, RANGES, THRESHOLDS, (3, 5), "dt", **_K))
