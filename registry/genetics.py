"""Linkage, distances, decompositions and outliers on the derived cohort."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from demescope.functions.ld_measures import CELLS, haplotype_counts, with_haplotypes, with_ld
from demescope.functions.vectors import METRICS, vector_distance
from demescope.operators import distance, ld, outliers, qc, reduce, reshape
from demescope.schema import VARIANT
from registry.catalogue import ORACLES, query, r6
from registry.cohort import BASE, dosages, numbered, regions, table

MAX_BP = 5000
CELL_SQL = ", ".join(
    f"count(*) filter (where a.dosage = {x} and b.dosage = {y}) as n{x}{y}" for x in range(3) for y in range(3)
)
NEAR = f"""
, near as (
  select a.contig, a.snp_idx as idx_a, b.snp_idx as idx_b from snps a join snps b
  on a.contig = b.contig and a.snp_idx < b.snp_idx and b.pos - a.pos <= {MAX_BP}
), joint as (
  select a.contig, a.snp_idx as idx_a, b.snp_idx as idx_b, {CELL_SQL}
  from numbered a join numbered b on a.contig = b.contig and a.sample_id = b.sample_id and a.snp_idx < b.snp_idx
    and b.pos - a.pos <= {MAX_BP} group by 1, 2, 3
), counts as (
  select contig, idx_a, idx_b, {", ".join(f"coalesce({c}, 0) as {c}" for c in CELLS)} from near left join joint using (contig, idx_a, idx_b)
), sums as (
  select *, {" + ".join(CELLS)} as n, n10 + n11 + n12 + 2 * (n20 + n21 + n22) as sx, n01 + n11 + n21 + 2 * (n02 + n12 + n22) as sy,
    n10 + n11 + n12 + 4 * (n20 + n21 + n22) as sxx, n01 + n11 + n21 + 4 * (n02 + n12 + n22) as syy,
    n11 + 2 * (n12 + n21) + 4 * n22 as sxy from counts
), corr as (
  select contig, idx_a, idx_b, n as n_valid, case when n > 0 and (sxx - sx * sx / cast(n as double)) * (syy - sy * sy / cast(n as double)) > 1e-9
    then (sxy - sx * sy / cast(n as double)) / sqrt((sxx - sx * sx / cast(n as double)) * (syy - sy * sy / cast(n as double))) end as ld from sums
)"""
LD_COLUMNS = "contig, idx_a, idx_b, cast(n_valid as bigint) as n_valid, round(ld, 6) + 0.0 as ld"


def counts(spark, sf):
    return ld.pair_counts(numbered(spark, sf), MAX_BP)


@query("pair_counts", f"{NEAR} select contig, idx_a, idx_b, {', '.join(f'cast({c} as bigint) as {c}' for c in CELLS)} from counts")
def pair_counts(spark, sf):
    return counts(spark, sf)


def ld_query(spark, sf, method):
    pairs = ld.ld_pairs(numbered(spark, sf), method, MAX_BP)
    return pairs.select("contig", "idx_a", "idx_b", "n_valid", (r6("ld") + 0.0).alias("ld"))


@query("ld_corr", f"{NEAR} select {LD_COLUMNS} from corr")
def ld_corr(spark, sf):
    return ld_query(spark, sf, "corr")


@query("ld_composite", f"{NEAR} select {LD_COLUMNS} from corr")
def ld_composite(spark, sf):
    return ld_query(spark, sf, "composite")


HAPLO = f"""
{NEAR}, hap as (
  select contig, idx_a, idx_b, n as n_valid, cast(2 * n22 + n21 + n12 as double) as haa, cast(2 * n20 + n21 + n10 as double) as hab,
    cast(2 * n02 + n01 + n12 as double) as hba, cast(2 * n00 + n01 + n10 as double) as hbb, cast(n11 as double) as dh from sums
)"""
LL = "haa * ln(p1 + 2.220446049250313e-16) + hab * ln(p2 + 2.220446049250313e-16) + hba * ln(p3 + 2.220446049250313e-16) + hbb * ln(p4 + 2.220446049250313e-16)"
EM = f"""{HAPLO}
, begun as (
  select contig, idx_a, idx_b, haa, hab, hba, hbb, dh, haa + hab + hba + hbb + 2 * dh as tot,
    (haa + 0.01) / (haa + hab + hba + hbb + 0.04) as p1, (hab + 0.01) / (haa + hab + hba + hbb + 0.04) as p2,
    (hba + 0.01) / (haa + hab + hba + hbb + 0.04) as p3, (hbb + 0.01) / (haa + hab + hba + hbb + 0.04) as p4
  from hap where dh > 0
), steps as (
  select *, {LL} as ll, greatest(abs(1.4901161193847656e-08 * ({LL})), 2.220446049250313e-16) as tol, 0 as it, false as done from begun
  union all
  select contig, idx_a, idx_b, haa, hab, hba, hbb, dh, tot, p1, p2, p3, p4, {LL} as ll, tol, it + 1, abs(ll - ({LL})) <= tol
  from (
    select contig, idx_a, idx_b, haa, hab, hba, hbb, dh, tot, ll, tol, it,
      (haa + f * dh) / tot as p1, (hab + (1 - f) * dh) / tot as p2, (hba + (1 - f) * dh) / tot as p3, (hbb + f * dh) / tot as p4
    from (select *, p1 * p4 / (p1 * p4 + p2 * p3) as f from steps where not done and it < 999) q
  ) r
), em as (
  select contig, idx_a, idx_b, max_by(p1, it) as p1, max_by(p2, it) as p2, max_by(p3, it) as p3, max_by(p4, it) as p4
  from steps group by 1, 2, 3
), shares as (
  select contig, idx_a, idx_b, n_valid,
    coalesce(em.p1, case when n_valid > 0 then haa / (2 * n_valid) end) as p1, coalesce(em.p2, case when n_valid > 0 then hab / (2 * n_valid) end) as p2,
    coalesce(em.p3, case when n_valid > 0 then hba / (2 * n_valid) end) as p3, coalesce(em.p4, case when n_valid > 0 then hbb / (2 * n_valid) end) as p4
  from hap left join em using (contig, idx_a, idx_b)
), margins as (
  select *, p1 + p2 as ma, p1 + p3 as mb, p4 + p3 as qa, p4 + p2 as qb, p1 - (p1 + p2) * (p1 + p3) as d from shares
), ldr as (
  select contig, idx_a, idx_b, n_valid, case when ma * mb * qa * qb > 0 then d / sqrt(ma * mb * qa * qb) end as r,
    case when (case when d >= 0 then least(ma * qb, qa * mb) else greatest(-ma * mb, -qa * qb) end) <> 0
      then d / (case when d >= 0 then least(ma * qb, qa * mb) else greatest(-ma * mb, -qa * qb) end) end as dp from margins
)"""


@query("haplotype_counts", f"{HAPLO} select contig, idx_a, idx_b, haa as \"hAA\", hab as \"hAB\", hba as \"hBA\", hbb as \"hBB\", 2 * dh as \"hDH2\" from hap")
def haplotype_table(spark, sf):
    return counts(spark, sf).select("contig", "idx_a", "idx_b", *haplotype_counts())


@query("haplotype_shares")
def haplotype_share_table(spark, sf):
    shares = with_haplotypes(counts(spark, sf))
    return shares.select("contig", "idx_a", "idx_b", *[(r6(F.col("hap")[c]) + 0.0).alias(c) for c in ("pAA", "pAB", "pBA", "pBB")])


@query("ld_r")
def ld_r(spark, sf):
    return ld_query(spark, sf, "r")


@query("ld_dprime")
def ld_dprime(spark, sf):
    return ld_query(spark, sf, "dprime")


def recursive(name, text):
    """Registers SQL with a recursion: the keyword belongs at the head of the whole statement."""
    ORACLES[name] = (BASE.rstrip() + text).replace("with people as", "with recursive people as", 1)


for _name, _column in (("ld_r", "r"), ("ld_dprime", "dp")):
    recursive(_name, f"{EM} select contig, idx_a, idx_b, cast(n_valid as bigint) as n_valid, round({_column}, 6) + 0.0 as ld from ldr")
recursive("haplotype_shares", EM + """ select contig, idx_a, idx_b, round(p1, 6) + 0.0 as "pAA", round(p2, 6) + 0.0 as "pAB",
  round(p3, 6) + 0.0 as "pBA", round(p4, 6) + 0.0 as "pBB" from shares""")


def scan_sql(condition, start=0, undefined="false"):
    """The greedy scan over the variants meeting a condition: upward from ``start``, downward below it, one step per variant."""
    return f"""{NEAR}, rates as (
  select contig, pos, ref_allele, alt_allele, least(sum(dosage) / (2.0 * count(*)), 1.0 - sum(dosage) / (2.0 * count(*))) as maf
  from dosages group by 1, 2, 3, 4
), picked as (
  select snps.*, maf, snp_idx < {start} as down,
    row_number() over (partition by contig, snp_idx < {start} order by case when snp_idx < {start} then -snp_idx else snp_idx end) as rn
  from snps join rates using (contig, pos, ref_allele, alt_allele) where {condition}
), blocked as (
  select corr.contig, x.down, greatest(x.rn, y.rn) as rn, list(least(x.rn, y.rn)) as partners
  from corr join picked x on x.snp_idx = idx_a join picked y on y.snp_idx = idx_b
  where x.down = y.down and not coalesce(abs(ld) <= 0.2, {undefined}) group by 1, 2, 3
), walk as (
  select contig, down, cast(1 as bigint) as rn, count(*) as last, [cast(1 as bigint)] as kept from picked group by contig, down
  union all
  select w.contig, w.down, w.rn + 1, w.last,
    case when b.partners is not null and list_has_any(w.kept, b.partners) then w.kept else list_append(w.kept, w.rn + 1) end
  from walk w left join blocked b on b.contig = w.contig and b.down = w.down and b.rn = w.rn + 1 where w.rn < w.last
), pruned as (
  select picked.* from (select contig, down, unnest(kept) as rn from walk where rn = last) k join picked using (contig, down, rn)
)"""


recursive("ld_pruned", scan_sql("true") + f" select snp_idx, {', '.join(VARIANT)} from pruned")


@query("ld_pruned")
def ld_pruned(spark, sf):
    """Variants left after pruning; variants are named by their alleles."""
    cells = numbered(spark, sf)
    kept = ld.ld_prune(ld.ld_pairs(cells, "composite", MAX_BP), ld.snp_positions(cells), 0.2)
    return cells.select("snp_idx", *VARIANT).distinct().join(kept, ["contig", "snp_idx"], "left_semi")


def pruned_as(name, **options):
    """Pruning from a start in the middle, or with undefined linkage let pass."""
    start, undefined = options.get("start_idx", 0), "true" if options.get("undefined") == "keep" else "false"
    recursive(name, scan_sql("true", start, undefined) + f" select snp_idx, {', '.join(VARIANT)} from pruned")

    @query(name)
    def run(spark, sf):
        cells = numbered(spark, sf)
        kept = ld.ld_prune(ld.ld_pairs(cells, "composite", MAX_BP), ld.snp_positions(cells), 0.2, **options)
        return cells.select("snp_idx", *VARIANT).distinct().join(kept, ["contig", "snp_idx"], "left_semi")


pruned_as("ld_pruned_from", start_idx=120)
pruned_as("ld_pruned_undefined", undefined="keep")


# --- distances ---------------------------------------------------------------------------

DIFFERENCES = """
, diffs as (
  select a.sample_no as sample_a, b.sample_no as sample_b, count(*) as n_valid,
    count(*) filter (where abs(a.dosage - b.dosage) = 1) as off_by_1, count(*) filter (where abs(a.dosage - b.dosage) = 2) as off_by_2
  from numbered a join numbered b on a.snp_idx = b.snp_idx and a.sample_no < b.sample_no group by 1, 2
)"""


def distances(metric, p=2):
    def run(spark, sf):
        d = distance.sample_distances(numbered(spark, sf), metric, p)
        return d.select("sample_a", "sample_b", "n_valid", r6("distance").alias("distance"))

    return run


for _name, _metric, _p, _sql in [
    ("dist_hamming", "hamming", 2, "cast(off_by_1 + off_by_2 as double)"),
    ("dist_manhattan", "manhattan", 1, "cast(off_by_1 + 2 * off_by_2 as double)"),
    ("dist_euclidean", "euclidean", 2, "sqrt(off_by_1 + 4 * off_by_2)"),
    ("dist_minkowski3", "minkowski", 3, "pow(off_by_1 + 8 * off_by_2, 1.0 / 3.0)"),
]:
    query(_name, f"{DIFFERENCES} select sample_a, sample_b, n_valid, round({_sql}, 6) as distance from diffs")(distances(_metric, _p))


@query("vector_to_centroid", f"""
with c as (select label, i, avg(cast(embedding[i] as double)) as m from embeddings, unnest(range(1, len(embedding) + 1)) u(i) group by 1, 2),
x as (select vec_id, e.label, abs(cast(embedding[u.i] as double) - m) as d
  from embeddings e, unnest(range(1, len(embedding) + 1)) u(i) join c on c.label = e.label and c.i = u.i)
select vec_id, round(sqrt(sum(d * d)), 6) as euclidean, round(sum(d), 6) as manhattan, round(pow(sum(d * d * d), 1.0 / 3.0), 6) as minkowski,
  cast(count(*) filter (where d > 1e-12) as double) as hamming from x group by 1""", base=False)
def vector_to_centroid(spark, sf):
    """Every metric as an expression: each vector against the mean of its label."""
    from demescope.operators.cluster_metrics import centroids

    points = distance.as_points(table(spark, sf, "embeddings"), "vec_id", "embedding", cluster="label")
    centres = centroids(points).select("cluster", F.col("centre"))
    both = points.join(centres, "cluster")
    return both.select(
        F.col("id").alias("vec_id"),
        *[r6(vector_distance("features", "centre", m, 3)).alias(m) for m in METRICS],
    )


# --- decompositions ----------------------------------------------------------------------


def vectors(spark, sf):
    cells = numbered(spark, sf)
    return reshape.sample_vectors(cells, regions(spark, sf))


@query("pca_samples")
def pca_samples(spark, sf):
    scores, _ = reduce.sample_pca(numbered(spark, sf), 4)
    return reshape.with_components(reduce.labelled(scores, regions(spark, sf)), 4)


@query("eigenvalue_table")
def eigenvalue_table(spark, sf):
    _, values = reduce.sample_pca(numbered(spark, sf), 10)
    return reduce.eigenvalue_table(values)


@query("pca_randomized")
def pca_randomized(spark, sf):
    scores, _ = reduce.sample_pca(numbered(spark, sf), 4, method="Randomized")
    return reshape.with_components(reduce.labelled(scores, regions(spark, sf)), 4)


@query("pca_features")
def pca_features(spark, sf):
    scores, _ = reduce.pca_features(vectors(spark, sf), 4)
    return reshape.with_components(scores, 4)


@query("pca_scaled")
def pca_scaled(spark, sf):
    scores = reduce.pca_scaled(vectors(spark, sf), 10, 0.7)
    return scores.select("sample_id", "region", F.size(vector_to_array("features")).alias("n_components"))


@query("pca_on_split")
def pca_on_split(spark, sf):
    scores = reduce.pca_on_split(vectors(spark, sf), 20, 0.6)
    return scores.select("sample_id", "region", F.size(vector_to_array("features")).alias("n_components"))


@query("mds_manhattan")
def mds_manhattan(spark, sf):
    cells = numbered(spark, sf)
    n = cells.agg(F.max("sample_no") + 1).first()[0]
    scores = reduce.classical_mds(distance.sample_distances(cells, "manhattan", rescale=True, listed=False), n, 20, 0.7)
    named = scores.join(cells.select("sample_id", "sample_no").distinct(), "sample_no")
    return reduce.labelled(named, regions(spark, sf)).select("sample_id", "region", F.size(vector_to_array("features")).alias("n_axes"))


# --- outliers ----------------------------------------------------------------------------


@query("half_sample_stats", """
, u as (select sample, r, cast(('0x' || substr(md5(sample || '#' || cast(r as varchar) || ':1234'), 1, 8)) as bigint) / 4294967296.0 as u
  from people, (values (1), (2), (3), (4)) reps(r))
select r as repeat, contig, pos, ref_allele, alt_allele, count(*) as n, round(avg(dosage), 6) as mean, round(var_samp(dosage), 6) as variance
from dosages join u on sample = sample_id where u < 0.5 group by 1, 2, 3, 4, 5""")
def half_sample_stats(spark, sf):
    rows = dosages(spark, sf)
    stats = outliers.half_sample_stats(rows, reshape.half_samples(regions(spark, sf), 4))
    return stats.select("repeat", *VARIANT, "n", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("outlier_samples", """
, nv as (select count(*) as nv from snps), stats as (
  select sample_id, count(*) as n_calls, avg(dosage) as mean_dosage, avg(cast(dosage = 1 as double)) as heterozygosity,
    1.0 - count(*) / cast(any_value(nv) as double) as missing_rate from dosages, nv group by sample_id
), z as (
  select sample_id, n_calls, (mean_dosage - avg(mean_dosage) over ()) / stddev_samp(mean_dosage) over () as z_mean_dosage,
    (heterozygosity - avg(heterozygosity) over ()) / stddev_samp(heterozygosity) over () as z_heterozygosity,
    (missing_rate - avg(missing_rate) over ()) / stddev_samp(missing_rate) over () as z_missing_rate from stats
)
select sample_id, n_calls, round(z_mean_dosage, 6) as z_mean_dosage, round(z_heterozygosity, 6) as z_heterozygosity, round(z_missing_rate, 6) as z_missing_rate
from z where abs(z_mean_dosage) > 1.5 or abs(z_heterozygosity) > 1.5 or abs(z_missing_rate) > 1.5""")
def outlier_samples(spark, sf):
    found = outliers.outlier_samples(qc.sample_stats(dosages(spark, sf)), 1.5)
    return found.select("sample_id", "n_calls", *[r6(f"z_{m}").alias(f"z_{m}") for m in outliers.OUTLIER_MEASURES])
