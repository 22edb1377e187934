"""URL rules, and a verdict for the rest from two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demescope.session import cut_lineage

ORDER = 5
FOLDS = 5
EDGE = "\u0002"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed by the task: (verdict, rule), a rule being a host and the start of a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def url_host(url: str | Column = "url") -> Column:
    """What stands between ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: str | Column = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict): the longest rule that fits host and path, else null."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def _windows(urls: DataFrame, order: int) -> DataFrame:
    """Every character of a URL (and its end) with the ``order - 1`` before it, as rows."""
    padded = F.concat(F.lit(EDGE * (order - 1)), F.lower("url"), F.lit(EDGE))
    at = F.explode(F.sequence(F.lit(1), F.char_length(F.lower("url")) + 1))
    return urls.withColumn("padded", padded).select("*", at.alias("at")).withColumn("w", F.col("padded").substr(F.col("at"), F.lit(order))).drop("padded", "at")


def language_models(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """w, ratio: for every window that occurs, log P(last character | those before) of accepted over rejected URLs.

    ``windows``: one row a distinct window with its counts ``good`` and ``bad`` in the training URLs. The
    order varies with what was seen: Witten-Bell smoothing mixes each context's distribution with the one
    of the context a character shorter, by the number of different characters that followed it, down to a
    uniform one over the characters that occur.
    """
    symbols = windows.select(F.substring("w", order, 1).alias("c")).distinct().count()
    out = windows.withColumn("p_good", F.lit(1.0) / max(1, symbols)).withColumn("p_bad", F.col("p_good"))
    for k in range(1, order + 1):
        gram, context = F.substring("w", order - k + 1, k), F.substring("w", order - k + 1, k - 1)
        grams = windows.groupBy(gram.alias("g")).agg(F.sum("good").alias("g_good"), F.sum("bad").alias("g_bad"))
        contexts = (
            grams.groupBy(F.substring("g", 1, k - 1).alias("h"))
            .agg(
                F.sum("g_good").alias("h_good"),
                F.sum("g_bad").alias("h_bad"),
                F.count_if(F.col("g_good") > 0).alias("t_good"),
                F.count_if(F.col("g_bad") > 0).alias("t_bad"),
            )
        )
        out = out.withColumn("g", gram).withColumn("h", context).join(grams, "g").join(contexts, "h")
        for side in ("good", "bad"):
            n, t = F.col(f"h_{side}"), F.col(f"t_{side}")
            mixed = (F.col(f"g_{side}") + t * F.col(f"p_{side}")) / (n + t)
            out = out.withColumn(f"p_{side}", F.when(n > 0, mixed).otherwise(F.col(f"p_{side}")))
        out = out.select("w", "good", "bad", "p_good", "p_bad")
    return out.select("w", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, order: int = ORDER, bins: int = 400) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    URLs that a rule decides are the accepted and rejected examples. Those of four folds of five (by hash
    of the URL) are counted into two character models; the score of any URL is the difference of its two
    log-likelihoods per character. The threshold is the score, on a grid of ``bins`` steps over -10..10,
    that best parts the fifth fold's accepted from its rejected URLs (mean of the two shares; the middle
    of equal ones). URLs without a rule are allowed from the threshold on.

    The rule decides where one fits. Null, empty and odd URLs have empty host and path and are scored like
    any text; where only one kind of example exists all others get its verdict, where none exists they are
    allowed. Repeated URLs count and are scored once each per row; other columns are ignored. Distinct
    windows are aggregated before any join, so a host with a third of the rows is a few counted rows.
    """
    parsed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    parsed = apply_rules(parsed.withColumn("host", url_host()).withColumn("path", url_path()), rules)
    urls = parsed.groupBy("url").agg(F.first("ruled").alias("ruled"), F.count("*").alias("n"))
    urls = cut_lineage(urls.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0))
    trains = ~F.col("held")
    windows = _windows(urls, order)
    counts = cut_lineage(
        windows.groupBy("w").agg(
            F.sum(F.when(trains & (F.col("ruled") == "allow"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(trains & (F.col("ruled") == "block"), F.col("n")).otherwise(0)).alias("bad"),
        )
    )
    model = cut_lineage(language_models(counts, order))
    scores = windows.select("url", "w").join(model, "w").groupBy("url").agg(F.avg("ratio").alias("score"))
    scored = cut_lineage(urls.join(scores, "url"))
    threshold = _threshold(scored, bins)
    by_method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    out = parsed.join(scored.select("url", "score"), "url")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "score")


def _threshold(scored: DataFrame, bins: int) -> float:
    """The score that best parts the held-out examples, from a histogram of at most ``bins`` rows a kind."""
    step = 20 / bins
    binned = F.floor((F.greatest(F.lit(-10.0), F.least(F.lit(9.999), "score")) + 10) / step)
    held = scored.filter(F.col("held") & F.col("ruled").isNotNull())
    rows = held.groupBy(binned.alias("bin"), "ruled").agg(F.sum("n").alias("n")).collect()
    good, bad = [0] * bins, [0] * bins
    for r in rows:
        (good if r["ruled"] == "allow" else bad)[r["bin"]] += r["n"]
    if not sum(bad):
        return float("-inf")
    if not sum(good):
        return float("inf")
    worth = [sum(good[k:]) / sum(good) + sum(bad[:k]) / sum(bad) for k in range(bins + 1)]
    best = [k for k, v in enumerate(worth) if v == max(worth)]
    return best[len(best) // 2] * step - 10
