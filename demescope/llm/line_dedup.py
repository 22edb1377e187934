"""Lines that a large share of a site's pages have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demescope.llm.common import look_up
from demescope.session import cut_lineage

RATIO = 0.01
LEAST_PAGES = 2  # a line of one page alone is not repeated


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from a taken one."""
    out = []
    for name in names:
        while name.lower() in {t.lower() for t in taken}:
            name = "_" + name
        out.append(name)
    return out


def boilerplate_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host: str = "source") -> DataFrame:
    """host, line (MD5), pages, rows: the lines of more than ``ratio`` of their host's pages, on ``least_pages`` at least.

    Pages are different texts: copies of one page count once. Blank lines are never listed.
    """
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""))
    each = pages.select("host", _digest(F.col("text")).alias("page"), F.explode(lines).alias("l")).select("host", "page", _digest(F.col("l")).alias("line"))
    counted = each.groupBy("host", "line", "page").agg(F.count("*").alias("rows"))
    counted = counted.groupBy("host", "line").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows")).filter(F.col("pages") >= least_pages)
    totals = pages.select("host", _digest(F.col("text")).alias("page")).distinct().groupBy("host").agg(F.count("*").alias("total"))
    return counted.join(totals, "host").filter(F.col("pages") > ratio * F.col("total")).select("host", "line", "pages", "rows")


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host: str = "source") -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of ``text``, and columns n_lines, n_dropped.

    A line goes where it equals one of ``boilerplate_lines`` of its row's host (null hosts are one host
    named by the empty string). A row keeps its place even if all its lines go; null text becomes empty.
    Columns n_lines and n_dropped of the input are replaced, all others stay. An empty table stays empty.

    Lines are counted as digests, pre-aggregated before each shuffle, so a line or host with a third of the
    rows is one row a task. Which rows have boilerplate lines is found on digests too; a text is shuffled
    once, to meet its own row's list.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    key, joint, drop, lines, kept = _unused(names, "key", "joint", "drop", "lines", "kept")
    text = F.coalesce("text", F.lit(""))
    marks = F.struct(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col("doc_id").cast("string").alias("doc_id"), _digest(text).alias("page"))
    keyed = docs.withColumn("text", text).withColumn(key, marks)
    found = cut_lineage(boilerplate_lines(docs, ratio, least_pages, host))
    each = keyed.select(F.col(key).alias("key"), F.col(f"{key}.host").alias("host"), F.explode(F.array_distinct(_lines(F.col("text")))).alias("l"))
    each = each.select("key", "host", _digest(F.col("l")).alias("line"))
    drops = look_up(each, found, ["host", "line"], "rows").groupBy("key").agg(F.collect_set("line").alias(drop))
    as_text = lambda c: F.to_json(F.col(c).withField("page", F.hex(f"{c}.page"))).alias(joint)
    joined = keyed.select("*", as_text(key)).drop(key).join(drops.select(as_text("key"), drop), joint, "left").withColumn(lines, _lines(F.col("text")))
    stay = F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _digest(x))))
    joined = joined.withColumn(kept, stay)
    joined = joined.withColumn("text", F.array_join(kept, "\n")).withColumn("n_lines", F.size(lines)).withColumn("n_dropped", F.size(lines) - F.size(kept))
    return joined.select(*names, "n_lines", "n_dropped")
