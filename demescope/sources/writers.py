"""Writers. Every sink but ``write_single_csv`` writes in parallel."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.schema import VARIANT


def write_variant_summary(variants: DataFrame, path: str, mode: str = "error") -> None:
    """Variant table laid out by contig and sorted by position, so later range filters prune."""
    laid_out = variants.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos")
    laid_out.write.mode(mode).partitionBy("contig").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "error") -> None:
    """A directory of CSV parts."""
    df.write.mode(mode).option("header", header).csv(path)


def write_single_csv(df: DataFrame, path: str, header: bool = True, mode: str = "error") -> None:
    """One CSV part in a directory; for report-sized tables (one task writes it all)."""
    df.coalesce(1).write.mode(mode).option("header", header).csv(path)


def prediction_path(base: str, *methods: str) -> str:
    """Default output name: the base followed by the method names in order."""
    return "_".join([base, *[m for m in methods if m]])


def write_predictions(predictions: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """SampleId, Region, Predict, label, features with the vector as a plain array."""
    out = predictions.select(
        F.col("sample_id").alias("SampleId"),
        F.col("region").alias("Region"),
        F.col("prediction").alias("Predict"),
        "label",
        vector_to_array("features").alias("features"),
    )
    if fmt == "csv":
        out = out.withColumn("features", F.array_join(F.col("features").cast("array<string>"), " "))
    out.write.mode(mode).format(fmt).option("header", True).save(path)


def write_snp_panel(variants: DataFrame, path: str, mode: str = "error") -> None:
    """Chosen variants as contigName, start, id."""
    panel = variants.select(
        F.col("contig").alias("contigName"), F.col("pos").alias("start"), F.col("snp_idx").alias("id")
    )
    panel.write.mode(mode).option("header", True).csv(path)


def write_genotype_subset(
    dosages: DataFrame,
    path: str,
    variants: DataFrame | None = None,
    samples: DataFrame | None = None,
    mode: str = "error",
) -> None:
    """Dosages restricted to given variants and samples, laid out by contig and position."""
    subset = dosages
    if variants is not None:
        subset = subset.join(variants.select(*VARIANT), VARIANT, "left_semi")
    if samples is not None:
        subset = subset.join(samples.select("sample_id"), "sample_id", "left_semi")
    laid_out = subset.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos")
    laid_out.write.mode(mode).partitionBy("contig").parquet(path)
