"""Exact duplicates by merging sorted runs of digests in binomial rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demescope.llm.common import WHITE, look_up
from demescope.session import cut_lineage

KEY = ["sha", "check", "norm_bytes"]


def _merged(runs: DataFrame, place: Column) -> DataFrame:
    """Runs of one place merged: per verified digest the best candidate and the rows so far."""
    return (
        runs.withColumn("place", place)
        .groupBy("place", *KEY)
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )


def exact_duplicates(docs: DataFrame, fan_in_bits: int = 3, levels: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. The row with the
    most code points in its original text stays, of those the smallest doc_id (null last), of those the one with the
    smaller hash of its text; of equal rows any one. So exactly one row of a group is kept.

    Every scan task makes one run: its digests, each with its best candidate and count. Runs are numbered
    and merged in ``levels`` rounds of ``2 ** fan_in_bits`` runs each. In a round the runs whose numbers
    differ in the round's bits exchange parts: these bits of a row's place change from its run's to its
    digest's. After the last round a place is a digest prefix, so equal digests have met. Each level keeps
    the smallest candidate of a digest, and rows count as the same digest only where SHA-256, a second
    hash and the length of the normalised text agree. A hot group is one row per task from the first
    exchange on. Only DataFrame functions are used.

    Null text is empty; empty texts are one group; repeated doc_ids are counted as rows of their own; an
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, WHITE + "+", "")
    digests = cut_lineage(
        docs.select("doc_id", F.char_length(text).alias("chars"), F.xxhash64(text).alias("mark"), norm.alias("norm")).select(
            "doc_id",
            "chars",
            "mark",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"),
            F.xxhash64("norm").alias("check"),
            F.octet_length("norm").alias("norm_bytes"),
        )
    )
    bits = fan_in_bits * levels
    prefix = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("bigint")
    digest_place = F.pmod(prefix, F.lit(1 << bits))
    runs = (
        digests.withColumn("best", F.struct((-F.col("chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "row"))
        .withColumn("n", F.lit(1).cast("bigint"))
        .withColumn("place", F.pmod(F.spark_partition_id(), F.lit(1 << bits)).cast("bigint"))
    )
    for level in range(levels):
        mask = ((1 << fan_in_bits) - 1) << (fan_in_bits * level)
        place = F.col("place").bitwiseAND(F.lit(~mask)).bitwiseOR(digest_place.bitwiseAND(F.lit(mask)))
        runs = _merged(runs, place)
    groups = cut_lineage(runs.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size")))
    out = look_up(digests.select("doc_id", "row", *KEY), groups, KEY, "group_size")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
