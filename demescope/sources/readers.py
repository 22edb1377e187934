"""Readers for the tables the operators take."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demescope.functions.alleles import dosage
from demescope.schema import CALLS, PANEL, SNP_PANEL, VARIANT_SUMMARY

POPULATION_LEVELS = ("pop", "super_pop")


def read_calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nested genotype calls; unused nested fields are pruned at the scan."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(CALLS).parquet(*paths)


def flatten_calls(calls: DataFrame, encoder: str = "alt_only") -> DataFrame:
    """Nested calls to flat columns with the allele array and its dosage."""
    return calls.select(
        F.col("sampleId").alias("sample_id"),
        F.col("variant.contig.contigName").alias("contig"),
        F.col("variant.start").alias("pos"),
        F.col("variant.referenceAllele").alias("ref_allele"),
        F.col("variant.alternateAllele").alias("alt_allele"),
        "alleles",
        dosage("alleles", encoder).alias("dosage"),
    )


def read_panel(
    spark: SparkSession,
    path: str,
    level: str = "super_pop",
    populations: Iterable[str] | None = None,
) -> DataFrame:
    """Tab-separated sample panel to ``(sample_id, region)`` at one population level."""
    if level not in POPULATION_LEVELS:
        raise ValueError(f"level must be one of {POPULATION_LEVELS}")
    rows = spark.read.csv(path, sep="\t", header=True, schema=PANEL, enforceSchema=True)
    labelled = rows.select(F.col("sample").alias("sample_id"), F.col(level).alias("region"))
    if populations is not None:
        labelled = labelled.filter(F.col("region").isin(list(populations)))
    return labelled


def read_panel_renamed(spark: SparkSession, path: str) -> DataFrame:
    """The whole panel under the names SampleId, Sub-region, Region, Gender."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=PANEL, enforceSchema=True)
    return rows.withColumnsRenamed(
        {"sample": "SampleId", "pop": "Sub-region", "super_pop": "Region", "gender": "Gender"}
    )


def read_snp_panel(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated list of chosen variants: contigName, start, id."""
    return spark.read.csv(path, header=True, schema=SNP_PANEL, enforceSchema=True)


def read_variant_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per-variant summary written earlier, genotype texts included."""
    return spark.read.schema(VARIANT_SUMMARY).parquet(path)


def read_wide_parquet(spark: SparkSession, path: str, n_columns: int | None = None) -> DataFrame:
    """Wide sample matrix to long form, keeping the first ``n_columns`` variants if given.

    Only the chosen columns are read from the files.
    """
    wide = spark.read.parquet(path)
    return melt_matrix(first_feature_columns(wide, n_columns))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated wide matrix; every column but the two keys is a double.

    The header row alone decides the schema, so the data are read once.
    """
    names = spark.read.csv(path, sep=";", header=True, inferSchema=False).columns
    schema = T.StructType(
        [
            T.StructField(c, T.StringType() if c in ("SampleId", "Region") else T.DoubleType())
            for c in names
        ]
    )
    return spark.read.csv(path, sep=";", header=True, schema=schema)


def first_feature_columns(wide: DataFrame, n_columns: int | None) -> DataFrame:
    """SampleId, Region and the first ``n_columns`` features; all of them when out of range."""
    features = [c for c in wide.columns if c not in ("SampleId", "Region")]
    if n_columns is not None and 0 < n_columns < len(features):
        features = features[:n_columns]
    return wide.select("SampleId", "Region", *[F.col(f"`{c}`") for c in features])


def melt_matrix(wide: DataFrame) -> DataFrame:
    """Wide matrix to ``(SampleId, Region, variant_id, value)``; null cells are missing and left out."""
    features = [c for c in wide.columns if c not in ("SampleId", "Region")]
    long = wide.unpivot(
        ["SampleId", "Region"], [F.col(f"`{c}`") for c in features], "variant_id", "value"
    )
    return long.filter(F.col("value").isNotNull())
