"""Quality control: per-variant and per-sample summaries and the filters on them.

All take long tables (one row per sample and variant). Summaries are plain hash aggregates
with map-side partial results, so a variant or sample holding most rows is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demescope.functions.alleles import has_known_allele, is_snv, pack_genotype
from demescope.schema import SITE, UNKNOWN_REGION, VARIANT

FREQUENCY_MEASURES = ("mean_dosage", "af", "maf", "carrier_frequency")


# --- sizes -------------------------------------------------------------------------------


def cohort_size(calls: DataFrame, approx: bool = False) -> DataFrame:
    """One row, one column ``n_samples``."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return calls.agg(count("sample_id").cast("long").alias("n_samples"))


def size_column(n_samples: int | DataFrame) -> Column:
    return n_samples.scalar() if isinstance(n_samples, DataFrame) else F.lit(n_samples)


# --- per-variant summaries ---------------------------------------------------------------


def variant_summary(
    calls: DataFrame,
    n_samples: int | DataFrame | None = None,
    snv_only: bool = True,
    with_genotypes: bool = False,
) -> DataFrame:
    """Calls to one row per variant: nonmissing, alt_count, mean_dosage, af, maf, missing_rate.

    ``mean_dosage`` divides by the cohort size and lies in 0..2; ``af`` and ``maf`` divide by the
    called allele slots. ``n_samples`` may be a known number or a one-cell table; without it
    the cohort is counted from the calls. ``with_genotypes`` adds the ``sample:dosage`` texts
    (one entry per sample in one row, so only for cohorts whose row fits a task).
    """
    n = size_column(cohort_size(calls) if n_samples is None else n_samples)
    rows = calls.filter(is_snv("ref_allele", "alt_allele")) if snv_only else calls
    measures = [
        F.count("dosage").alias("nonmissing"),
        F.sum("dosage").cast("long").alias("alt_count"),
    ]
    if with_genotypes:
        measures.append(F.sort_array(F.collect_set(pack_genotype("sample_id", "dosage"))).alias("genotype"))
    out = rows.groupBy(*VARIANT).agg(*measures)
    return with_rates(out, n)


def with_rates(variants: DataFrame, n: Column) -> DataFrame:
    """Frequencies and missing rate from ``nonmissing`` and ``alt_count``; null where nothing is called."""
    called = F.col("nonmissing") > 0
    af = F.when(called, F.col("alt_count") / (2.0 * F.col("nonmissing")))
    return (
        variants.withColumn("mean_dosage", F.col("alt_count") / n.cast("double"))
        .withColumn("af", af)
        .withColumn("maf", F.least(F.col("af"), 1.0 - F.col("af")))
        .withColumn("missing_rate", 1.0 - F.col("nonmissing") / n.cast("double"))
    )


def snp_rates(dosages: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Allele frequency, minor allele frequency and missing rate per variant for given samples."""
    if samples is None:
        rows, n = dosages, cohort_size(dosages)
    else:
        rows = dosages.join(samples.select("sample_id"), "sample_id", "left_semi")
        n = samples.agg(F.count_distinct("sample_id").cast("long").alias("n_samples"))
    return variant_summary(rows, n, snv_only=False)


def allele_totals(calls: DataFrame) -> DataFrame:
    """Allele slots and non-reference alleles per variant."""
    return calls.groupBy(*VARIANT).agg(
        F.sum(F.size("alleles")).cast("long").alias("allele_slots"),
        F.sum(F.size(F.filter("alleles", lambda a: a != "Ref"))).cast("long").alias("alt_total"),
    )


def carrier_frequency(calls: DataFrame, n_samples: int | DataFrame | None = None) -> DataFrame:
    """Calls per variant and the share of the cohort carrying at least one alternate allele."""
    n = size_column(cohort_size(calls) if n_samples is None else n_samples)
    return (
        calls.groupBy(*VARIANT)
        .agg(
            F.count("dosage").alias("n_calls"),
            F.count(F.when(F.col("dosage") > 0, 1)).alias("n_carriers"),
        )
        .withColumn("carrier_frequency", F.col("n_carriers") / n.cast("double"))
    )


def genotype_sets(calls: DataFrame) -> DataFrame:
    """Distinct dosages seen per variant, ascending."""
    return calls.groupBy(*VARIANT).agg(F.sort_array(F.collect_set("dosage")).alias("dosages"))


# --- per-sample summaries ----------------------------------------------------------------


def sample_stats(dosages: DataFrame, n_variants: int | DataFrame | None = None) -> DataFrame:
    """Calls, missing rate, mean dosage and heterozygosity of each sample."""
    if n_variants is None:
        n_variants = dosages.select(*VARIANT).distinct().agg(F.count("*").alias("n_variants"))
    n = size_column(n_variants)
    return (
        dosages.groupBy("sample_id")
        .agg(
            F.count("dosage").alias("n_calls"),
            F.avg("dosage").alias("mean_dosage"),
            F.avg((F.col("dosage") == 1).cast("double")).alias("heterozygosity"),
        )
        .withColumn("missing_rate", 1.0 - F.col("n_calls") / n.cast("double"))
    )


def sample_dosage(calls: DataFrame, by_site: bool = False) -> DataFrame:
    """Dosage summed per sample and variant, leaving out calls with only unknown alleles.

    ``by_site`` adds up the variants sharing a position.
    """
    keys = SITE if by_site else VARIANT
    known = calls.filter(has_known_allele("alleles"))
    return known.groupBy("sample_id", *keys).agg(F.sum("dosage").cast("int").alias("dosage"))


def distinct_counts(dosages: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: distinct calls and distinct regions among the sampled."""
    labelled = label_regions(dosages, regions)
    return labelled.agg(
        F.count_distinct("sample_id", *VARIANT).alias("n_records"),
        F.count_distinct("region").alias("n_regions"),
    )


# --- filters -----------------------------------------------------------------------------


def biallelic(variants: DataFrame) -> DataFrame:
    """Variants (one row each) at positions with exactly one alternate allele."""
    single = variants.groupBy(*SITE).agg(F.count_distinct("alt_allele").alias("n_alts")).filter("n_alts = 1")
    return variants.join(single.select(*SITE), SITE, "left_semi")


def enough_calls(calls: Column, n_samples: Column, missing_rate: float) -> Column:
    """Whether ``calls`` of ``n_samples`` leave at most ``missing_rate`` missing; exact at the limit.

    Counts are compared: the limit is rounded up to a whole number of calls after a margin far below one
    call, as a product such as 10 * (1 - 0.7) may come out above 3.
    """
    return calls >= F.ceil(n_samples * F.lit(1.0 - missing_rate) - F.lit(1e-9))


def complete(variants: DataFrame, n_samples: int | DataFrame, missing_rate: float = 0.0) -> DataFrame:
    """Variants called in at least ``1 - missing_rate`` of the cohort."""
    _check_share("missing_rate", missing_rate)
    return variants.filter(enough_calls(F.col("nonmissing"), size_column(n_samples), missing_rate))


def frequency_between(
    variants: DataFrame,
    low: float,
    high: float,
    measure: str = "maf",
    bounds: str = "inclusive",
) -> DataFrame:
    """Variants whose frequency lies in the range; ``bounds`` is inclusive or strict."""
    if measure not in FREQUENCY_MEASURES:
        raise ValueError(f"measure must be one of {FREQUENCY_MEASURES}")
    f = F.col(measure)
    if bounds == "inclusive":
        return variants.filter((f >= low) & (f <= high))
    if bounds == "strict":
        return variants.filter((f > low) & (f < high))
    raise ValueError("bounds must be 'inclusive' or 'strict'")


def in_interval(df: DataFrame, start: int, end: int, contig: str | None = None) -> DataFrame:
    """Rows with positions in ``start..end``; on sorted files the scan skips other row groups."""
    rows = df.filter(F.col("pos").between(start, end))
    return rows if contig is None else rows.filter(F.col("contig") == contig)


def keep_samples(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of the listed samples."""
    return df.join(samples.select("sample_id"), "sample_id", "left_semi")


def keep_variants(df: DataFrame, variants: DataFrame, keys: Iterable[str] = tuple(VARIANT)) -> DataFrame:
    """Rows of the listed variants. Spark broadcasts the list only under its own size limit."""
    keys = list(keys)
    return df.join(variants.select(*keys).distinct(), keys, "left_semi")


def drop_samples(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of samples not listed (the complement of ``keep_samples``)."""
    return df.join(samples.select("sample_id"), "sample_id", "left_anti")


def label_regions(df: DataFrame, regions: DataFrame, default: str = UNKNOWN_REGION) -> DataFrame:
    """Adds ``region`` from a ``(sample_id, region)`` panel; unlisted samples get the default."""
    joined = df.join(regions.select("sample_id", "region"), "sample_id", "left")
    return joined.withColumn("region", F.coalesce("region", F.lit(default)))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that fail; a null outcome fails."""
    passed = F.coalesce(predicate, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def replicate(df: DataFrame, times: int, suffix: bool = False) -> DataFrame:
    """Every row ``times`` times, optionally with the copy number appended to the sample id."""
    if times < 1:
        raise ValueError("times must be at least 1")
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    if suffix:
        out = out.withColumn("sample_id", F.concat_ws("_", "sample_id", F.col("copy").cast("string")))
    return out


def _check_share(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie in 0..1")
