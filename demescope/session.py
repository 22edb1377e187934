"""Shared storage for lineage cuts and hand-over tables."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one, whose executors share the driver's disk, gets a folder of its own; on a
    cluster the setting has to be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="demescope-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, below one folder per application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/demescope-{app}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the table to shared storage and reads it back, so a lost executor costs a re-read only.

    Unlike a checkpoint the rows are computed once, and later readers prune columns and know the size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The table cached while in use; one the caller already caches is left as it is."""
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


ROWS_PER_FIT_TASK = 20_000


@contextmanager
def fit_table(df: DataFrame) -> Iterator[DataFrame]:
    """A training table cached in partitions sized by its rows.

    Solvers run hundreds of passes; on a table of a few rows in many partitions the tasks, not the
    arithmetic, would set the pace.
    """
    parts = max(1, math.ceil(df.count() / ROWS_PER_FIT_TASK))
    with held(df.repartition(parts)) as rows:
        yield rows
