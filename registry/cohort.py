"""A genotype cohort derived from the sales tables, for Spark and, as text, for SQL.

Suppliers are the samples, their nation and region the population labels. A part's type is the
contig, its size the position; every supplier and variant met in ``lineitem`` is one call whose
alleles follow from the keys of those lines. So calls grow with ``lineitem``, samples with
``supplier``; a call is missing where no line exists. Allele frequencies differ by region,
neighbouring variants are correlated, some sites have two alternates, some an unknown
allele, some never vary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demescope.functions.alleles import dosage, has_known_allele
from demescope.operators.ld import number_cells
from demescope.session import cut_lineage

CONTIGS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_key, sample, pop, super_pop, gender, region_no."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("sample_key"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample"),
            F.col("n_name").alias("pop"),
            F.col("r_name").alias("super_pop"),
            F.when(F.col("s_suppkey") % 2 == 0, "male").otherwise("female").alias("gender"),
            F.col("r_regionkey").alias("region_no"),
        )
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("sample", "pop", "super_pop", "gender")


def regions(spark: SparkSession, sf_dir: str, level: str = "super_pop") -> DataFrame:
    return people(spark, sf_dir).select(F.col("sample").alias("sample_id"), F.col(level).alias("region"))


def calls(spark: SparkSession, sf_dir: str, encoder: str = "alt_only") -> DataFrame:
    """Flat calls: sample_id, contig, pos, ref_allele, alt_allele, alleles, dosage."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    contig_no = F.lit(None).cast("int")
    for i, name in enumerate(CONTIGS):
        contig_no = F.when(F.col("p_type") == name, i + 1).otherwise(contig_no)
    site_no = (F.col("contig_no") - 1) * 50 + F.col("p_size") - 1
    alts = F.when(F.col("site_no") % 13 == 0, F.when(F.col("brand_no") % 2 == 0, "C").otherwise("G")).otherwise(
        F.element_at(F.array(F.lit("C"), F.lit("G"), F.lit("T")), (F.col("site_no") % 3 + 1).cast("int"))
    )
    sites = (
        part.select(
            "p_partkey", "p_size", contig_no.alias("contig_no"), F.substring("p_brand", 7, 5).cast("int").alias("brand_no")
        )
        .withColumn("site_no", site_no.cast("bigint"))
        .withColumn("alt_allele", alts)
    )
    cells = (
        lines.select("l_suppkey", "l_partkey", "l_orderkey")
        .join(sites, lines.l_partkey == sites.p_partkey)
        .groupBy("l_suppkey", "contig_no", "p_size", "site_no", "alt_allele")
        .agg(F.sum(F.col("l_partkey") + F.col("l_orderkey")).alias("k"))
        .join(people(spark, sf_dir).select("sample_key", "sample", "region_no"), F.col("l_suppkey") == F.col("sample_key"))
    )
    s, site = F.col("sample_key"), F.col("site_no")
    blk = site - site % 3
    t = 60 + (site * 37 + F.col("region_no") * (site % 7) * 53) % 450
    u1 = F.when(site % 3 == 1, (s * 6151 + blk * 7919 + s * blk * 29) % 1009).otherwise(
        (F.col("k") * 7919 + s * 104729 + site * 31) % 1009
    )
    u2 = (s * 6151 + blk * 15485863 + s * blk * 17) % 1013

    def allele(u, every):
        return (
            F.when(site % 29 == 7, "Ref")
            .when((site % 13 == 0) & ((s + 3 * site) % every == 0), "OtherAlt")
            .when(u < t, "Alt")
            .otherwise("Ref")
        )

    return cells.select(
        F.col("sample").alias("sample_id"),
        F.col("contig_no").cast("string").alias("contig"),
        (F.col("p_size") * 1000).cast("bigint").alias("pos"),
        F.when(site % 19 == 0, "AT").otherwise("A").alias("ref_allele"),
        "alt_allele",
        F.array(allele(u1, 7), allele(u2, 5)).alias("alleles"),
    ).withColumn("dosage", dosage("alleles", encoder))


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long dosages of single-base variants, without calls of only unknown alleles."""
    rows = calls(spark, sf_dir).filter(has_known_allele("alleles"))
    return rows.filter((F.length("ref_allele") == 1) & (F.length("alt_allele") == 1)).drop("alleles")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dosages with ``snp_idx`` and ``sample_no``, written out once for the pairwise operators."""
    return cut_lineage(number_cells(cut_lineage(dosages(spark, sf_dir))))


BASE = """
with people as (
  select s_suppkey as sample_key, 'S' || cast(s_suppkey as varchar) as sample, n_name as pop, r_name as super_pop,
    case when s_suppkey % 2 = 0 then 'male' else 'female' end as gender, r_regionkey as region_no
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), sites0 as (
  select p_partkey, p_size, cast(substr(p_brand, 7) as int) as brand_no,
    case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 when 'PROMO' then 4 when 'SMALL' then 5
      when 'STANDARD' then 6 end as contig_no
  from part
), sites1 as (
  select *, cast((contig_no - 1) * 50 + p_size - 1 as bigint) as site_no from sites0
), sites as (
  select *, case when site_no % 13 = 0 then case when brand_no % 2 = 0 then 'C' else 'G' end
    when site_no % 3 = 0 then 'C' when site_no % 3 = 1 then 'G' else 'T' end as alt_allele
  from sites1
), cells as (
  select l_suppkey as s, contig_no, p_size, site_no, alt_allele, cast(sum(l_partkey + l_orderkey) as bigint) as k
  from lineitem join sites on l_partkey = p_partkey group by all
), drawn as (
  select sample as sample_id, cast(contig_no as varchar) as contig, cast(p_size * 1000 as bigint) as pos,
    case when site_no % 19 = 0 then 'AT' else 'A' end as ref_allele, alt_allele, s, site_no,
    60 + (site_no * 37 + region_no * (site_no % 7) * 53) % 450 as t,
    case when site_no % 3 = 1 then (s * 6151 + (site_no - site_no % 3) * 7919 + s * (site_no - site_no % 3) * 29) % 1009
      else (k * 7919 + s * 104729 + site_no * 31) % 1009 end as u1,
    (s * 6151 + (site_no - site_no % 3) * 15485863 + s * (site_no - site_no % 3) * 17) % 1013 as u2
  from cells join people on s = sample_key
), alleled as (
  select sample_id, contig, pos, ref_allele, alt_allele,
    case when site_no % 29 = 7 then 'Ref' when site_no % 13 = 0 and (s + 3 * site_no) % 7 = 0 then 'OtherAlt'
      when u1 < t then 'Alt' else 'Ref' end as a1,
    case when site_no % 29 = 7 then 'Ref' when site_no % 13 = 0 and (s + 3 * site_no) % 5 = 0 then 'OtherAlt'
      when u2 < t then 'Alt' else 'Ref' end as a2
  from drawn
), calls as (
  select *, cast(a1 = 'Alt' as int) + cast(a2 = 'Alt' as int) as dosage from alleled
), dosages as (
  select sample_id, contig, pos, ref_allele, alt_allele, dosage from calls
  where not (a1 = 'OtherAlt' and a2 = 'OtherAlt') and length(ref_allele) = 1 and length(alt_allele) = 1
), snps as (
  select *, row_number() over (order by contig, pos, ref_allele, alt_allele) - 1 as snp_idx
  from (select distinct contig, pos, ref_allele, alt_allele from dosages)
), samples as (
  select *, row_number() over (order by sample_id) - 1 as sample_no from (select distinct sample_id from dosages)
), numbered as (
  select d.*, snp_idx, sample_no from dosages d join snps using (contig, pos, ref_allele, alt_allele) join samples using (sample_id)
)
"""
