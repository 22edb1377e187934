"""Collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.cohort import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Registers a query; ``sql`` continues the cohort's common table expressions unless ``base`` is off."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            joiner = "\n" if not text.startswith(",") else ""
            ORACLES[name] = (BASE.rstrip() + joiner + text) if base else text
        return fn

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, where the order of a floating sum may differ between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def listed(c: Column | str) -> Column:
    """An array as comma-separated text."""
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",")
