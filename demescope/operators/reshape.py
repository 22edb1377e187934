"""Indexing, reshaping, ordering and sampling of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demescope.operators.qc import label_regions
from demescope.schema import VARIANT
from demescope.session import cut_lineage

_ROW_BITS = 33


# --- dense numbering ---------------------------------------------------------------------


def dense_index(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Gap-free 0-based numbers in the order of ``keys``, without a single-task sort.

    Rows are range partitioned, sorted inside each partition and written out with their
    place; a partition's offset is the sum of the sizes before it (one number per partition).
    """
    return number_rows(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Gap-free 0-based numbers of the rows as they lie; the table is written, so that they stay."""
    placed = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of the sorted table
        .withColumn(name, (F.col("_offset") + row).cast("long"))
        .drop("_at", "_part", "_offset")
    )


def snp_index(variants: DataFrame, name: str = "snp_idx") -> DataFrame:
    """Numbers variants by contig, position and alleles."""
    return dense_index(variants, VARIANT, name)


def sample_index(samples: DataFrame, name: str = "sample_no") -> DataFrame:
    """Numbers distinct samples by id."""
    return dense_index(samples.select("sample_id").distinct(), ["sample_id"], name)


# --- matrices ----------------------------------------------------------------------------


def sample_arrays(dosages: DataFrame, block: int = 4096) -> DataFrame:
    """Each sample's variants in index order, ``block`` variants per row.

    Blocking bounds the row, so a sample with every variant of a genome is many rows.
    """
    return (
        dosages.groupBy("sample_id", F.floor(F.col("snp_idx") / block).cast("long").alias("block_no"))
        .agg(F.sort_array(F.collect_list(F.struct("snp_idx", "dosage"))).alias("_cells"))
        .select(
            "sample_id",
            "block_no",
            F.col("_cells.snp_idx").alias("snp_idx"),
            F.col("_cells.dosage").alias("dosage"),
        )
    )


def sample_vectors(dosages: DataFrame, regions: DataFrame, missing: str = "mean", block: int = 4096) -> DataFrame:
    """``(sample_id, region, features)``: one dense vector per sample, aligned by ``snp_idx``.

    The indexes present are closed up to 0..p-1. A missing cell takes the variant's mean
    (``missing='mean'``) or 0. Variants are numbered and filled in blocks of ``block``; only the
    finished vector is as long as the cohort has variants.
    """
    if missing not in ("mean", "zero"):
        raise ValueError("missing must be 'mean' or 'zero'")
    fill = F.avg("dosage") if missing == "mean" else F.lit(0.0)
    columns = dense_index(dosages.groupBy("snp_idx").agg(fill.cast("double").alias("fill")), ["snp_idx"], "_no")
    at = F.floor(F.col("_no") / block).cast("long").alias("_block")
    fills = columns.groupBy(at).agg(F.array_sort(F.collect_list(F.struct("_no", "fill"))).alias("_fills"))
    called = dosages.filter(F.col("dosage").isNotNull())
    cells = (
        called.join(columns.select("snp_idx", "_no"), "snp_idx")
        .groupBy("sample_id", at)
        .agg(F.map_from_entries(F.collect_list(F.struct((F.col("_no") % block).cast("int"), F.col("dosage").cast("double")))).alias("_cells"))
    )
    blocks = columns.agg(F.max("_no")).first()[0]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks or 0) // block).cast("long"))).alias("_block")
    grid = called.select("sample_id").distinct().select("sample_id", every).join(cells, ["sample_id", "_block"], "left").join(fills, "_block")
    filled = F.transform("_fills", lambda f, i: F.coalesce(F.element_at("_cells", i), f["fill"]))
    parts = grid.select("sample_id", F.struct("_block", filled.alias("v")).alias("_part"))
    whole = parts.groupBy("sample_id").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return label_regions(whole, regions).select(
        "sample_id", "region", array_to_vector(F.flatten(F.col("_parts.v"))).alias("features")
    )


def wide_matrix(dosages: DataFrame, regions: DataFrame, ids: Sequence[str], id_col: str = "variant_id") -> DataFrame:
    """SampleId, Region and one double column per listed variant id; for short lists."""
    pivoted = (
        dosages.filter(F.col(id_col).isin(list(ids)))
        .groupBy("sample_id")
        .pivot(id_col, list(ids))
        .agg(F.sum("dosage").cast("double"))
    )
    names = [F.col(f"`{c}`") for c in ids]
    return label_regions(pivoted, regions).select(
        F.col("sample_id").alias("SampleId"), F.col("region").alias("Region"), *names
    )


def with_components(df: DataFrame, k: int, vector: str = "features", prefix: str = "PC") -> DataFrame:
    """SampleId, Region, PC1..PCk from a vector column."""
    values = vector_to_array(vector)
    return df.select(
        F.col("sample_id").alias("SampleId"),
        F.col("region").alias("Region"),
        *[values[i].alias(f"{prefix}{i + 1}") for i in range(k)],
    )


def assemble(
    df: DataFrame,
    label: str = "Region",
    ignored: Sequence[str] = ("SampleId",),
) -> DataFrame:
    """Wide numeric columns to ``(sample_id, region, features)``."""
    names = [c for c in df.columns if c != label and c not in ignored]
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    return df.select(
        F.col(ignored[0]).alias("sample_id"),
        F.col(label).alias("region"),
        array_to_vector(features).alias("features"),
    )


def slice_vector(df: DataFrame, k: int, vector: str = "features") -> DataFrame:
    """The first ``k`` entries of a vector column."""
    return df.withColumn(vector, array_to_vector(F.slice(vector_to_array(vector), 1, k)))


def transpose_rows(df: DataFrame, row_no: str, values: str, block: int = 4096) -> DataFrame:
    """Rows of an array matrix to its columns: ``(col_no, block_no, values)``.

    A column of the input is cut into blocks of ``block`` rows, so tall matrices do not
    build unbounded arrays.
    """
    cells = df.select(F.col(row_no).alias("row_no"), F.posexplode(values).alias("col_no", "value"))
    return (
        cells.groupBy("col_no", F.floor(F.col("row_no") / block).cast("long").alias("block_no"))
        .agg(F.sort_array(F.collect_list(F.struct("row_no", "value"))).alias("_cells"))
        .select("col_no", "block_no", F.col("_cells.value").alias("values"))
    )


def melt(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide report columns to rows."""
    measures = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), measures, name, value)


def cross_table(scores: DataFrame, rows: Sequence[str], column: str, columns: Sequence, value: str) -> DataFrame:
    """Tuning scores as a matrix: one row per setting, one column per listed value of ``column``."""
    return scores.groupBy(*rows).pivot(column, list(columns)).agg(F.max(value))


# --- order statistics -------------------------------------------------------------------


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Share and running share of ``value`` in the given order, over tables of any length.

    Rows are range partitioned and sorted; sums run inside a partition and start from the sum of
    those before it (one number per partition).
    """
    placed = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS).cast("int")
    sums = placed.groupBy(part.alias("part")).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("s")).collect()
    before, total = {}, 0.0
    for r in sorted(sums, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["s"]
    offsets = F.lit([before.get(p, 0.0) for p in range(max(before, default=0) + 1)])
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = (F.coalesce(inside, F.lit(0)) + F.element_at(offsets, F.col("_part") + 1)) / F.lit(total)
    shares = placed.withColumn("_part", part).withColumn("share", F.col(value) / F.lit(total)).withColumn("cum_share", running)
    return shares.drop("_at", "_part")


def components_under(df: DataFrame, order: str, value: str, threshold: float) -> DataFrame:
    """One row ``n_components``: leading entries whose running share stays within the threshold."""
    shares = cumulative_share(df, order, value)
    return shares.agg(F.count(F.when(F.col("cum_share") <= threshold, 1)).alias("n_components"))


def best_by(df: DataFrame, score: str, ties: Sequence[str], groups: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """The row with the best score (per group); equal scores go to the smallest ``ties``."""
    direction = F.col(score).cast("double") if lowest else -F.col(score).cast("double")
    rank = F.struct(direction.alias("_score"), *[F.col(c) for c in ties])
    keep = [c for c in df.columns if c not in groups]
    best = df.groupBy(*groups).agg(F.min_by(F.struct(*keep), rank).alias("_best"))
    return best.select(*groups, *[F.col("_best")[c].alias(c) for c in keep])


# --- sampling ----------------------------------------------------------------------------


def hash_share(key: Column | str, seed: int) -> Column:
    """A reproducible number in [0, 1) for a key, independent of partitioning and row order."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def split_rows(df: DataFrame, train_share: float, seed: int = 1234, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Disjoint training and validation rows; a row's side depends on its key alone."""
    u = hash_share(key, seed)
    return df.filter(u < train_share), df.filter(u >= train_share)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 1234, key: str = "sample_id") -> DataFrame:
    """Each row is drawn at most once, with probability ``fraction``."""
    return df.filter(hash_share(key, seed) < fraction)


def half_samples(samples: DataFrame, repeats: int, seed: int = 1234) -> DataFrame:
    """``(sample_id, repeats)``: the repeats in whose random half each sample falls."""
    drawn = F.filter(
        F.sequence(F.lit(1), F.lit(repeats)),
        lambda r: hash_share(F.concat_ws("#", F.col("sample_id"), r.cast("string")), seed) < 0.5,
    )
    return samples.select("sample_id").distinct().select("sample_id", drawn.alias("repeats"))


def top_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*order).limit(n)
