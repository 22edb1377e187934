"""Outlying samples, and the spread of dosages over random half-samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTLIER_MEASURES = ("mean_dosage", "heterozygosity", "missing_rate")


def half_sample_stats(dosages: DataFrame, membership: DataFrame, by: str = "variant") -> DataFrame:
    """Mean and sample variance of dosage in every half-sample, per variant or per sample.

    ``membership`` is ``(sample_id, repeats array)``. A mean over a variant's calls.
    """
    keys = {"variant": ["contig", "pos", "ref_allele", "alt_allele"], "sample": ["sample_id"]}
    if by not in keys:
        raise ValueError("by must be 'variant' or 'sample'")
    rows = dosages.join(membership, "sample_id").withColumn("repeat", F.explode("repeats"))
    return rows.groupBy("repeat", *keys[by]).agg(
        F.count("dosage").alias("n"), F.avg("dosage").alias("mean"), F.var_samp("dosage").alias("variance")
    )


def outlier_samples(stats: DataFrame, z: float = 3.0) -> DataFrame:
    """Samples with a summary more than ``z`` standard deviations from the cohort's mean.

    ``stats`` come from ``sample_stats``. Adds one z-score per measure; a measure that does not
    vary flags nobody.
    """
    moments = stats.agg(
        F.struct(*[F.avg(m).alias(m) for m in OUTLIER_MEASURES]).alias("mean"),
        F.struct(*[F.stddev_samp(m).alias(m) for m in OUTLIER_MEASURES]).alias("sd"),
    )
    about = moments.select(F.struct("mean", "sd").alias("m")).scalar()
    scored = stats.withColumn("_m", about)
    for m in OUTLIER_MEASURES:
        sd = F.col("_m")["sd"][m]
        scored = scored.withColumn(f"z_{m}", F.when(sd > 0, (F.col(m) - F.col("_m")["mean"][m]) / sd).otherwise(0.0))
    far = F.lit(False)
    for m in OUTLIER_MEASURES:
        far = far | (F.abs(f"z_{m}") > z)
    return scored.filter(far).drop("_m")
