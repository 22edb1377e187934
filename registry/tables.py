"""Readers, writers, filters, joins, aggregates and reshaping on the derived cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from demescope.functions import alleles as al
from demescope.operators import qc, reshape
from demescope.operators.ld import window_pairs
from demescope.schema import VARIANT
from demescope.session import scratch_path
from demescope.sources import readers, writers
from registry.catalogue import listed, query, r6
from registry.cohort import calls, dosages, numbered, panel, people, regions, table

V = "contig, pos, ref_allele, alt_allele"
SUMMARY = f"""
, n as (select count(distinct sample_id) as n from calls), summary as (
  select {V}, count(dosage) as nonmissing, cast(sum(dosage) as bigint) as alt_count,
    sum(dosage) / cast(any_value(n) as double) as mean_dosage, sum(dosage) / (2.0 * count(dosage)) as af,
    least(sum(dosage) / (2.0 * count(dosage)), 1.0 - sum(dosage) / (2.0 * count(dosage))) as maf,
    1.0 - count(dosage) / cast(any_value(n) as double) as missing_rate
  from calls, n where length(ref_allele) = 1 and length(alt_allele) = 1 group by {V}
)"""
RATES = "round(mean_dosage, 6) as mean_dosage, round(af, 6) as af, round(maf, 6) as maf"
SUMMARY_COLUMNS = f"{V}, nonmissing, alt_count, {RATES}, round(missing_rate, 6) as missing_rate"


def rounded(variants):
    rates = ("mean_dosage", "af", "maf", "missing_rate")
    return variants.select(*VARIANT, "nonmissing", "alt_count", *[r6(c).alias(c) for c in rates])


# --- sources and sinks -------------------------------------------------------------------


def nested(flat):
    return flat.select(
        F.col("sample_id").alias("sampleId"),
        F.struct(
            F.struct(F.col("contig").alias("contigName")).alias("contig"),
            F.col("pos").alias("start"),
            (F.col("pos") + F.length("ref_allele")).alias("end"),
            F.col("ref_allele").alias("referenceAllele"),
            F.col("alt_allele").alias("alternateAllele"),
        ).alias("variant"),
        "alleles",
    )


@query("read_calls", f"select sample_id, {V}, a1 || '/' || a2 as genotype, dosage from calls")
def read_calls(spark, sf):
    path = scratch_path(spark, "calls")
    nested(calls(spark, sf)).write.parquet(path)
    flat = readers.flatten_calls(readers.read_calls(spark, path))
    return flat.select("sample_id", *VARIANT, F.array_join("alleles", "/").alias("genotype"), "dosage")


def panel_file(spark, sf):
    path = scratch_path(spark, "panel")
    panel(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return path


@query("read_panel", "select sample as sample_id, super_pop as region from people where super_pop in ('ASIA', 'EUROPE')")
def read_panel(spark, sf):
    return readers.read_panel(spark, panel_file(spark, sf), "super_pop", ["ASIA", "EUROPE"])


@query("read_panel_renamed", """select sample as "SampleId", pop as "Sub-region", super_pop as "Region", gender as "Gender" from people""")
def read_panel_renamed(spark, sf):
    return readers.read_panel_renamed(spark, panel_file(spark, sf))


@query("snp_panel_file", f"""
{SUMMARY} select contig as "contigName", pos as start, row_number() over (order by {V}) - 1 as id
from summary where maf > 0.05 and maf < 0.45""")
def snp_panel_file(spark, sf):
    chosen = qc.frequency_between(qc.variant_summary(calls(spark, sf)), 0.05, 0.45, "maf", "strict")
    path = scratch_path(spark, "snps")
    writers.write_snp_panel(reshape.snp_index(chosen), path)
    return readers.read_snp_panel(spark, path)


@query("summary_file", f"{SUMMARY} select {SUMMARY_COLUMNS} from summary")
def summary_file(spark, sf):
    path = scratch_path(spark, "summary")
    writers.write_variant_summary(qc.variant_summary(calls(spark, sf)), path)
    back = spark.read.schema("pos bigint, ref_allele string, alt_allele string, nonmissing bigint, alt_count bigint,"
                             "mean_dosage double, af double, maf double, missing_rate double, contig string").parquet(path)
    return rounded(back)


@query("legacy_summary_file", f"""
, n as (select count(distinct sample_id) as n from calls)
select contig as "contigName", pos as start, ref_allele as ref, alt_allele as alt, count(*) as nonmissing,
  round(sum(dosage) / cast(any_value(n) as double), 6) as frequency,
  string_agg(sample_id || '=' || cast(dosage as varchar), ',' order by sample_id) as genotypes
from calls, n where length(ref_allele) = 1 and length(alt_allele) = 1 group by {V}""")
def legacy_summary_file(spark, sf):
    full = reshape.snp_index(qc.variant_summary(calls(spark, sf), with_genotypes=True))
    path = scratch_path(spark, "legacy")
    full.select(
        F.col("snp_idx").alias("snpIdx"), F.col("contig").alias("contigName"), F.col("pos").alias("start"), "nonmissing",
        F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"), F.col("mean_dosage").alias("frequency"), "genotype",
    ).write.parquet(path)
    back = readers.read_variant_summary(spark, path)
    texts = F.transform(al.unpack_genotypes("genotype"), lambda g: F.concat(g["sample_id"], F.lit("="), g["dosage"].cast("string")))
    return back.select("contigName", "start", "ref", "alt", "nonmissing", r6("frequency").alias("frequency"),
                       F.array_join(texts, ",").alias("genotypes"))


def wide(spark, sf):
    """The wide matrix of all variants at single-alternate sites."""
    rows = calls(spark, sf).withColumn("variant_id", al.variant_id("contig", "pos"))
    sites = qc.biallelic(rows.select(*VARIANT).distinct())
    rows = qc.keep_variants(rows, sites).select("sample_id", "variant_id", "dosage")
    ids = [r[0] for r in rows.select("variant_id").distinct().orderBy("variant_id").collect()]
    return reshape.wide_matrix(rows, regions(spark, sf), ids)


LONG_WIDE = f"""
, single as (select contig, pos from calls group by contig, pos having count(distinct alt_allele) = 1)
select sample_id as "SampleId", super_pop as "Region", contig || ':' || cast(pos as varchar) as variant_id, cast(dosage as double) as value
from calls join single using (contig, pos) join people on sample = sample_id"""


@query("wide_parquet", LONG_WIDE)
def wide_parquet(spark, sf):
    path = scratch_path(spark, "wide")
    wide(spark, sf).write.parquet(path)
    return readers.read_wide_parquet(spark, path)


@query("wide_csv", LONG_WIDE)
def wide_csv(spark, sf):
    path = scratch_path(spark, "wide-csv")
    wide(spark, sf).write.option("header", True).option("sep", ";").csv(path)
    return readers.melt_matrix(readers.read_wide_csv(spark, path))


@query("csv_report", f"{SUMMARY} select contig, count(*) as n_variants, sum(nonmissing) as n_calls from summary group by contig")
def csv_report(spark, sf):
    report = qc.variant_summary(calls(spark, sf)).groupBy("contig").agg(
        F.count("*").alias("n_variants"), F.sum("nonmissing").alias("n_calls"))
    one, many = scratch_path(spark, "report"), scratch_path(spark, "report-parts")
    writers.write_single_csv(report, one)
    writers.write_csv(spark.read.csv(one, header=True, schema="contig string, n_variants bigint, n_calls bigint"), many)
    return spark.read.csv(many, header=True, schema="contig string, n_variants bigint, n_calls bigint")


@query("genotype_subset", f"""
{SUMMARY} select sample_id, {V}, dosage from dosages
where sample_id in (select sample from people where super_pop = 'ASIA')
  and exists (select 1 from summary s where s.contig = dosages.contig and s.pos = dosages.pos
    and s.ref_allele = dosages.ref_allele and s.alt_allele = dosages.alt_allele and s.maf between 0.1 and 0.5)""")
def genotype_subset(spark, sf):
    variants = qc.frequency_between(qc.variant_summary(calls(spark, sf)), 0.1, 0.5)
    samples = regions(spark, sf).filter("region = 'ASIA'")
    path = scratch_path(spark, "subset")
    writers.write_genotype_subset(dosages(spark, sf), path, variants, samples)
    back = spark.read.schema("sample_id string, pos bigint, ref_allele string, alt_allele string, dosage int, contig string").parquet(path)
    return back.select("sample_id", *VARIANT, "dosage")


# --- scalar expressions and filters -------------------------------------------------------


@query("dosage_encoders", f"""
select {V}, cast(sum(dosage) as bigint) as alt_only,
  cast(sum(cast(a1 <> 'Ref' as int) + cast(a2 <> 'Ref' as int)) as bigint) as non_ref from calls group by {V}""")
def dosage_encoders(spark, sf):
    return calls(spark, sf).groupBy(*VARIANT).agg(
        F.sum(al.dosage("alleles", "alt_only")).alias("alt_only"),
        F.sum(al.dosage("alleles", "non_ref")).alias("non_ref"))


@query("variant_ids", """
select distinct contig || ':' || cast(pos as varchar) as short_id,
  contig || ':' || cast(pos as varchar) || ':' || cast(pos + length(ref_allele) as varchar) as long_id from calls""")
def variant_ids(spark, sf):
    return calls(spark, sf).select(
        al.variant_id("contig", "pos").alias("short_id"),
        al.variant_id("contig", "pos", F.col("pos") + F.length("ref_allele")).alias("long_id")).distinct()


@query("variant_summary", f"{SUMMARY} select {SUMMARY_COLUMNS} from summary")
def variant_summary(spark, sf):
    return rounded(qc.variant_summary(calls(spark, sf)))


@query("snv_biallelic", f"""
{SUMMARY}, single as (select contig, pos from summary group by contig, pos having count(distinct alt_allele) = 1)
select {V}, nonmissing from summary join single using (contig, pos)""")
def snv_biallelic(spark, sf):
    return qc.biallelic(qc.variant_summary(calls(spark, sf))).select(*VARIANT, "nonmissing")


@query("quality_panel", f"""
{SUMMARY}, single as (select contig, pos from summary group by contig, pos having count(distinct alt_allele) = 1)
select {SUMMARY_COLUMNS} from summary join single using (contig, pos), n
where nonmissing >= n * (1.0 - 0.2) and maf >= 0.05 and maf <= 0.5""")
def quality_panel(spark, sf):
    """Single-base, single-alternate, complete and common variants: the flagship filter."""
    rows = calls(spark, sf)
    n = qc.cohort_size(rows)
    variants = qc.biallelic(qc.variant_summary(rows, n))
    return rounded(qc.frequency_between(qc.complete(variants, n, 0.2), 0.05, 0.5, "maf"))


@query("complete_variants", f"{SUMMARY} select {V}, nonmissing from summary, n where nonmissing >= n * (1.0 - 0.1)")
def complete_variants(spark, sf):
    rows = calls(spark, sf)
    return qc.complete(qc.variant_summary(rows), qc.cohort_size(rows), 0.1).select(*VARIANT, "nonmissing")


@query("maf_filter", f"{SUMMARY} select {V}, round(maf, 6) as maf from summary where maf > 0.1 and maf < 0.3")
def maf_filter(spark, sf):
    kept = qc.frequency_between(qc.variant_summary(calls(spark, sf)), 0.1, 0.3, "maf", "strict")
    return kept.select(*VARIANT, r6("maf").alias("maf"))


@query("mean_dosage_filter", f"{SUMMARY} select {V}, round(mean_dosage, 6) as mean_dosage from summary where mean_dosage between 0.2 and 0.6")
def mean_dosage_filter(spark, sf):
    kept = qc.frequency_between(qc.variant_summary(calls(spark, sf)), 0.2, 0.6, "mean_dosage")
    return kept.select(*VARIANT, r6("mean_dosage").alias("mean_dosage"))


@query("unknown_allele_calls", f"select {V}, count(*) as n_dropped from calls where a1 = 'OtherAlt' and a2 = 'OtherAlt' group by {V}")
def unknown_allele_calls(spark, sf):
    _, dropped = qc.split_by(calls(spark, sf), al.has_known_allele("alleles"))
    return dropped.groupBy(*VARIANT).agg(F.count("*").alias("n_dropped"))


@query("population_calls", "select pop, count(*) as n_calls from calls join people on sample = sample_id where super_pop in ('AFRICA', 'EUROPE') group by pop")
def population_calls(spark, sf):
    chosen = regions(spark, sf).filter(F.col("region").isin("AFRICA", "EUROPE"))
    kept = qc.keep_samples(calls(spark, sf), chosen)
    return qc.label_regions(kept, regions(spark, sf, "pop")).groupBy(F.col("region").alias("pop")).agg(F.count("*").alias("n_calls"))


@query("interval_calls", f"select {V}, count(*) as n_calls from calls where pos between 10000 and 20000 and contig = '2' group by {V}")
def interval_calls(spark, sf):
    return qc.in_interval(calls(spark, sf), 10_000, 20_000, "2").groupBy(*VARIANT).agg(F.count("*").alias("n_calls"))


@query("region_labels", """
select sample_id, coalesce(region, 'Unknown') as region, count(*) as n_calls from calls
left join (select sample, super_pop as region from people where super_pop <> 'AMERICA') on sample = sample_id group by 1, 2""")
def region_labels(spark, sf):
    known = regions(spark, sf).filter("region <> 'AMERICA'")
    return qc.label_regions(calls(spark, sf), known).groupBy("sample_id", "region").agg(F.count("*").alias("n_calls"))


@query("replicated_calls", """
select sample_id || '_' || cast(copy as varchar) as sample_id, count(*) as n_calls, cast(sum(dosage) as bigint) as alt_count
from calls, (values (1), (2), (3)) c(copy) group by 1""")
def replicated_calls(spark, sf):
    copies = qc.replicate(calls(spark, sf), 3, suffix=True)
    return copies.groupBy("sample_id").agg(F.count("*").alias("n_calls"), F.sum("dosage").alias("alt_count"))


@query("packed_genotypes", f"""
select {V}, string_agg(sample_id || ':' || cast(dosage as varchar), ',' order by sample_id || ':' || cast(dosage as varchar)) as genotype
from dosages group by {V}""")
def packed_genotypes(spark, sf):
    full = qc.variant_summary(dosages(spark, sf), with_genotypes=True)
    return full.select(*VARIANT, listed("genotype").alias("genotype"))


@query("kept_variant_columns", f"""
{SUMMARY} select sample_id, super_pop as region, {V}, dosage from dosages join people on sample = sample_id
where (contig, pos) in (select (contig, pos) from summary where maf >= 0.4)""")
def kept_variant_columns(spark, sf):
    chosen = qc.frequency_between(qc.variant_summary(calls(spark, sf)), 0.4, 0.5)
    kept = qc.keep_variants(dosages(spark, sf), chosen, ["contig", "pos"])
    return qc.label_regions(kept, regions(spark, sf)).select("sample_id", "region", *VARIANT, "dosage")


# --- joins -------------------------------------------------------------------------------


@query("dosage_long", f"""
{SUMMARY} select sample_id, {V}, cast(sum(dosage) as int) as dosage from calls
join summary using ({V}) where mean_dosage between 0.1 and 1.0 and not (a1 = 'OtherAlt' and a2 = 'OtherAlt') group by sample_id, {V}""")
def dosage_long(spark, sf):
    rows = calls(spark, sf)
    chosen = qc.frequency_between(qc.variant_summary(rows), 0.1, 1.0, "mean_dosage")
    return qc.sample_dosage(qc.keep_variants(rows, chosen)).select("sample_id", *VARIANT, "dosage")


@query("dosage_by_site", """
select sample_id, contig, pos, cast(sum(dosage) as int) as dosage from calls
where not (a1 = 'OtherAlt' and a2 = 'OtherAlt') group by sample_id, contig, pos""")
def dosage_by_site(spark, sf):
    return qc.sample_dosage(calls(spark, sf), by_site=True)


@query("samples_outside", "select sample_id, count(*) as n_calls from calls where sample_id not in (select sample from people where super_pop = 'ASIA') group by 1")
def samples_outside(spark, sf):
    rest = qc.drop_samples(calls(spark, sf), regions(spark, sf).filter("region = 'ASIA'"))
    return rest.groupBy("sample_id").agg(F.count("*").alias("n_calls"))


@query("window_pairs", """
select a.contig, a.snp_idx as idx_a, b.snp_idx as idx_b, a.pos as pos_a, b.pos as pos_b from snps a join snps b
on a.contig = b.contig and a.snp_idx < b.snp_idx and b.pos - a.pos <= 5000 and b.snp_idx - a.snp_idx <= 4""")
def pairs_in_window(spark, sf):
    snps = reshape.snp_index(dosages(spark, sf).select(*VARIANT).distinct())
    return window_pairs(snps, 5000, 4).select("contig", "idx_a", "idx_b", "pos_a", "pos_b")


# --- aggregates --------------------------------------------------------------------------


@query("cohort_size", "select count(distinct sample_id) as n_samples from calls")
def cohort_size(spark, sf):
    return qc.cohort_size(calls(spark, sf))


@query("allele_totals", f"""
select {V}, cast(2 * count(*) as bigint) as allele_slots,
  cast(sum(cast(a1 <> 'Ref' as int) + cast(a2 <> 'Ref' as int)) as bigint) as alt_total from calls group by {V}""")
def allele_totals(spark, sf):
    return qc.allele_totals(calls(spark, sf))


@query("carrier_frequency", f"""
, n as (select count(distinct sample_id) as n from calls)
select {V}, count(*) as n_calls, count(*) filter (where dosage > 0) as n_carriers,
  round(count(*) filter (where dosage > 0) / cast(any_value(n) as double), 6) as carrier_frequency from calls, n group by {V}""")
def carrier_frequency(spark, sf):
    return qc.carrier_frequency(calls(spark, sf)).withColumn("carrier_frequency", r6("carrier_frequency"))


@query("maf_table", f"""
, picked as (select sample from people where super_pop in ('ASIA', 'AMERICA')), n as (select count(*) as n from picked)
select {V}, round(sum(dosage) / (2.0 * count(*)), 6) as af,
  round(least(sum(dosage) / (2.0 * count(*)), 1.0 - sum(dosage) / (2.0 * count(*))), 6) as maf,
  round(1.0 - count(*) / cast(any_value(n) as double), 6) as missing_rate
from dosages join picked on sample = sample_id, n group by {V}""")
def maf_table(spark, sf):
    picked = regions(spark, sf).filter(F.col("region").isin("ASIA", "AMERICA"))
    return qc.snp_rates(dosages(spark, sf), picked).select(*VARIANT, *[r6(c).alias(c) for c in ("af", "maf", "missing_rate")])


@query("genotype_sets", f"""
select {V}, string_agg(distinct cast(dosage as varchar), ',' order by cast(dosage as varchar)) as dosages from dosages group by {V}""")
def genotype_sets(spark, sf):
    return qc.genotype_sets(dosages(spark, sf)).withColumn("dosages", listed("dosages"))


@query("sample_arrays", """
select sample_id, cast(floor(snp_idx / 64) as bigint) as block_no, string_agg(cast(snp_idx as varchar), ',' order by snp_idx) as snp_idx,
  string_agg(cast(dosage as varchar), ',' order by numbered.snp_idx) as dosage from numbered group by 1, 2""")
def sample_arrays(spark, sf):
    blocks = reshape.sample_arrays(numbered(spark, sf), 64)
    return blocks.select("sample_id", "block_no", listed("snp_idx").alias("snp_idx"), listed("dosage").alias("dosage"))


@query("distinct_counts", f"select count(distinct (sample_id, {V})) as n_records, count(distinct super_pop) as n_regions from calls join people on sample = sample_id")
def distinct_counts(spark, sf):
    return qc.distinct_counts(calls(spark, sf), regions(spark, sf))


@query("sample_stats", f"""
, n as (select count(*) as n from snps)
select sample_id, count(*) as n_calls, round(avg(dosage), 6) as mean_dosage, round(avg(cast(dosage = 1 as double)), 6) as heterozygosity,
  round(1.0 - count(*) / cast(any_value(n) as double), 6) as missing_rate from dosages, n group by sample_id""")
def sample_stats(spark, sf):
    stats = qc.sample_stats(dosages(spark, sf))
    return stats.select("sample_id", "n_calls", *[r6(c).alias(c) for c in ("mean_dosage", "heterozygosity", "missing_rate")])


# --- indexing, reshaping, ordering --------------------------------------------------------


@query("snp_index", f"select {V}, snp_idx from snps")
def snp_index(spark, sf):
    return reshape.snp_index(dosages(spark, sf).select(*VARIANT).distinct())


@query("sample_index", "select sample_id, sample_no from samples")
def sample_index(spark, sf):
    return reshape.sample_index(dosages(spark, sf))


@query("transpose_matrix", """
select cast(i - 1 as int) as col_no, cast(floor(vec_id / 128) as bigint) as block_no,
  string_agg(cast(cast(round(embedding[i] * 1000) as bigint) as varchar), ',' order by vec_id) as values
from embeddings, unnest(range(1, len(embedding) + 1)) u(i) group by 1, 2""", base=False)
def transpose_matrix(spark, sf):
    whole = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")).alias("v"))
    return reshape.transpose_rows(whole, "vec_id", "v", 128).withColumn("values", listed("values"))


REGION_MEANS = """
, per as (select super_pop as region, contig, avg(dosage) as m from dosages join people on sample = sample_id group by 1, 2)"""


def region_means(spark, sf):
    return qc.label_regions(dosages(spark, sf), regions(spark, sf)).groupBy("region", "contig").agg(F.avg("dosage").alias("m"))


@query("cross_table", f"""
{REGION_MEANS} select region, {", ".join(f"round(max(m) filter (where contig = '{c}'), 6) as c{c}" for c in range(1, 7))} from per group by region""")
def cross_table(spark, sf):
    names = [str(c) for c in range(1, 7)]
    wide_means = reshape.cross_table(region_means(spark, sf), ["region"], "contig", names, "m")
    return wide_means.select("region", *[r6(F.col(f"`{c}`")).alias(f"c{c}") for c in names])


@query("melted_table", f"{REGION_MEANS} select region, 'c' || contig as variable, round(m, 6) as value from per")
def melted_table(spark, sf):
    return reshape.melt(cross_table(spark, sf), ["region"]).filter("value is not null")


@query("cumulative_share", """
, per as (select super_pop as region, count(*) as n from calls join people on sample = sample_id group by 1)
select region, n, round(n / sum(n) over (), 6) as share, round(sum(n) over (order by region) / sum(n) over (), 6) as cum_share from per""")
def cumulative_share(spark, sf):
    per = qc.label_regions(calls(spark, sf), regions(spark, sf)).groupBy("region").agg(F.count("*").alias("n"))
    shares = reshape.cumulative_share(per, "region", "n")
    return shares.select("region", "n", r6("share").alias("share"), r6("cum_share").alias("cum_share"))


@query("components_under", """
, per as (select super_pop as region, count(*) as n from calls join people on sample = sample_id group by 1),
cum as (select sum(n) over (order by region) / cast(sum(n) over () as double) as c from per)
select count(*) as n_components from cum where c <= 0.7""")
def components_under(spark, sf):
    per = qc.label_regions(calls(spark, sf), regions(spark, sf)).groupBy("region").agg(F.count("*").alias("n"))
    return reshape.components_under(per, "region", "n", 0.7)


@query("best_variant", f"""
, f as (select {V}, sum(dosage) / (2.0 * count(*)) as af from dosages group by {V})
select contig, pos, ref_allele, alt_allele, round(af, 6) as af from f
qualify row_number() over (partition by contig order by af desc, pos, alt_allele) = 1""")
def best_variant(spark, sf):
    rates = qc.snp_rates(dosages(spark, sf)).select(*VARIANT, "af")
    best = reshape.best_by(rates, "af", ["pos", "alt_allele"], ["contig"])
    return best.select(*VARIANT, r6("af").alias("af"))


@query("top_samples", "select sample_id, count(*) as n_calls from calls group by 1 order by n_calls desc, sample_id limit 10")
def top_samples(spark, sf):
    counts = calls(spark, sf).groupBy("sample_id").agg(F.count("*").alias("n_calls"))
    return reshape.top_rows(counts, [F.desc("n_calls"), "sample_id"], 10)


@query("united_reports", """
select 'pop' as level, pop as name, count(*) as n from people group by pop
union all select 'super_pop', super_pop, count(*) from people group by super_pop""")
def united_reports(spark, sf):
    def level(name):
        return people(spark, sf).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(name).alias("level"), "name", "n")

    return level("pop").unionByName(level("super_pop"))


U = "cast(('0x' || substr(md5(sample || ':{seed}'), 1, 8)) as bigint) / 4294967296.0"


@query("split_rows", f"select sample as sample_id, case when {U.format(seed=1234)} < 0.7 then 'train' else 'test' end as side from people")
def split_rows(spark, sf):
    train, test = reshape.split_rows(regions(spark, sf), 0.7)
    return train.select("sample_id", F.lit("train").alias("side")).unionByName(test.select("sample_id", F.lit("test").alias("side")))


@query("sample_fraction", f"select sample as sample_id, super_pop as region from people where {U.format(seed=7)} < 0.67")
def sample_fraction(spark, sf):
    return reshape.sample_fraction(regions(spark, sf), 0.67, seed=7)
