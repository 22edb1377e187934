"""Grid search over quality-control settings, with the work shared between grid cells.

Frequencies are counted once, linkage once over all variants any frequency range admits
(a threshold only filters it), components once per (frequency range, threshold) at the largest count
asked for. A cell then fits its estimators on a prefix of written-out components.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.operators import classify, cluster, qc, reduce, reshape
from demescope.operators.contingency import agreement, confusion
from demescope.plans.quality import MAX_BP, Cohort
from demescope.session import cut_lineage, held

Range = tuple[float, float]
SETTING = ["cell", "min_maf", "max_maf", "ld", "npc"]
CLUSTERERS = tuple(cluster.TUNED)


@dataclass
class Tuning:
    """``scores``: one row per grid cell and algorithm. ``best``: the winning setting with its score."""

    scores: DataFrame
    best: dict


def _cells(cohort: Cohort, maf: Sequence[Range], ld: Sequence[float], npc: Sequence[int], max_bp: int, method: str, missing_rate: float) -> Iterable:
    """Yields ``(setting, labelled components)`` in grid order: frequency range, threshold, count."""
    admitted = F.lit(False)
    for low, high in maf:
        admitted = admitted | ((F.col("maf") > low) & (F.col("maf") < high))
    called = qc.enough_calls(F.col("nonmissing"), F.col("n_samples"), missing_rate)
    pairs = cohort.pairs(cohort.variants.filter(admitted & called), method, max_bp)
    number = itertools.count()
    for low, high in maf:
        snps = cohort.chosen(low, high, missing_rate)
        for threshold in ld:
            kept = cohort.pruned(snps, pairs, threshold)
            scores, _ = reduce.sample_pca(cohort.restrict(cut_lineage(kept)), max(npc))
            full = cut_lineage(reduce.labelled(scores, cohort.regions))
            for k in npc:
                yield (next(number), low, high, float(threshold), k), reshape.slice_vector(full, k)


def _grid(cohort: Cohort, maf, ld, npc, algorithms, score: Callable, columns: str, max_bp: int, method: str, missing_rate: float, parallelism: int) -> DataFrame:
    rows = []
    with ThreadPoolExecutor(parallelism) as pool:
        for setting, frame in _cells(cohort, maf, ld, npc, max_bp, method, missing_rate):
            # The estimators of a cell share its rows and run side by side.
            with held(frame) as rows_:
                run = inheritable_thread_target(lambda name, rows_=rows_: score(rows_, name))
                found = list(pool.map(run, algorithms))
            rows.extend((*setting, name, *values) for name, values in zip(algorithms, found))
    schema = f"cell int, min_maf double, max_maf double, ld double, npc int, algorithm string, {columns}"
    return cohort.cells.sparkSession.createDataFrame(rows, schema)


def tune_clusters(
    cohort: Cohort,
    maf: Sequence[Range] = ((0.005, 0.05),),
    ld: Sequence[float] = (0.2,),
    npc: Sequence[int] = (4,),
    algorithms: Sequence[str] = CLUSTERERS,
    n_clusters: int = 5,
    max_bp: int = MAX_BP,
    method: str = "composite",
    missing_rate: float = 0.0,
    parallelism: int = 3,
) -> Tuning:
    """Adjusted Rand index (percent) of each algorithm at each setting; the highest wins.

    Variants with more than ``missing_rate`` of their calls missing are left out, by default any missing one.
    """

    def score(frame: DataFrame, name: str):
        found = cluster.TUNED[name](frame, n_clusters)
        return (round(agreement(confusion(found, "region", "prediction")).first()["ari"], 2),)

    scores = _grid(cohort, maf, ld, npc, algorithms, score, "ari double", max_bp, method, missing_rate, parallelism)
    return Tuning(scores, best_by_score(scores))


def tune_classifiers(
    cohort: Cohort,
    maf: Sequence[Range] = ((0.005, 0.05),),
    ld: Sequence[float] = (0.2,),
    npc: Sequence[int] = (5,),
    algorithms: Sequence[str] = tuple(classify.CLASSIFIERS),
    train_share: float = 0.67,
    max_bp: int = MAX_BP,
    method: str = "composite",
    missing_rate: float = 0.0,
    parallelism: int = 3,
    start: tuple[float, float] = (200.0, 100.0),
    seed: int = 1234,
    **options,
) -> Tuning:
    """Train and test error (percent) of each algorithm at each setting; see ``best_by_gap``.

    ``missing_rate`` as in ``tune_clusters``.
    """

    def score(frame: DataFrame, name: str):
        row = classify.train_test_errors(frame, [name], train_share, seed, **options).first()
        return round(row["train_error"], 2), round(row["test_error"], 2)

    columns = "train_error double, test_error double"
    scores = _grid(cohort, maf, ld, npc, algorithms, score, columns, max_bp, method, missing_rate, parallelism)
    return Tuning(scores, best_by_gap(scores, *start))


def best_by_score(scores: DataFrame) -> dict:
    """The setting with the highest index; the earlier cell on equal ones."""
    return reshape.best_by(scores, "ari", ["cell", "algorithm"]).first().asDict()


def best_by_gap(scores: DataFrame, start_train: float = 200.0, start_test: float = 100.0) -> dict:
    """Walks the cells in order, each at its lowest errors, and takes one over the best so far when
    its gap between train and test is no wider and at least one error is lower."""
    per = scores.groupBy(*SETTING).agg(F.min("train_error").alias("train_error"), F.min("test_error").alias("test_error"))
    walk = per.orderBy("cell").collect()  # one row per grid cell
    best = {c: walk[0][c] for c in SETTING}
    train, test = start_train, start_test
    for row in walk:
        narrower = abs(row["train_error"] - row["test_error"]) <= abs(train - test)
        if narrower and (row["train_error"] < train or row["test_error"] < test):
            train, test = row["train_error"], row["test_error"]
            best = {c: row[c] for c in SETTING}
    return {**best, "train_error": train, "test_error": test}


def cross_table(scores: DataFrame, rows: Sequence[str], column: str, value: str) -> DataFrame:
    """The scores as the familiar matrix, e.g. thresholds down and algorithms across."""
    values = [r[0] for r in scores.select(column).distinct().orderBy(column).collect()]
    return reshape.cross_table(scores, rows, column, values, value)


# --- the named searches: which dimensions vary, the rest as single values -------------------


def tune_maf(cohort: Cohort, maf: Sequence[Range], ld: float = 0.2, npc: int = 4, **options) -> Tuning:
    return tune_clusters(cohort, maf, [ld], [npc], **options)


def tune_ld(cohort: Cohort, maf: Range, ld: Sequence[float], npc: int = 4, **options) -> Tuning:
    return tune_clusters(cohort, [maf], ld, [npc], **options)


def tune_npc(cohort: Cohort, maf: Range, npc: Sequence[int], ld: float = 0.2, **options) -> Tuning:
    return tune_clusters(cohort, [maf], [ld], npc, **options)


def tune_ld_maf(cohort: Cohort, maf: Sequence[Range], ld: Sequence[float], npc: int = 4, algorithm: str = "hierarchical", **options) -> Tuning:
    return tune_clusters(cohort, maf, ld, [npc], [algorithm], **options)


def tune_maf_npc(cohort: Cohort, maf: Sequence[Range], npc: Sequence[int], ld: float = 0.2, algorithm: str = "hierarchical", **options) -> Tuning:
    return tune_clusters(cohort, maf, [ld], npc, [algorithm], **options)


def tune_ld_npc(cohort: Cohort, maf: Range, ld: Sequence[float], npc: Sequence[int], algorithm: str = "hierarchical", **options) -> Tuning:
    return tune_clusters(cohort, [maf], ld, npc, [algorithm], **options)


def tune_maf_ld_npc(
    cohort: Cohort, maf: Sequence[Range], ld: Sequence[float], npc: Sequence[int], algorithm: str = "hierarchical", **options
) -> Tuning:
    return tune_clusters(cohort, maf, ld, npc, [algorithm], **options)


def tune_maf_class(cohort: Cohort, maf: Sequence[Range], ld: float = 0.2, npc: int = 5, **options) -> Tuning:
    return tune_classifiers(cohort, maf, [ld], [npc], **options)


def tune_ld_class(cohort: Cohort, maf: Range, ld: Sequence[float], npc: int = 5, **options) -> Tuning:
    return tune_classifiers(cohort, [maf], ld, [npc], **options)


def tune_npc_class(cohort: Cohort, maf: Range, npc: Sequence[int], ld: float = 0.2, **options) -> Tuning:
    return tune_classifiers(cohort, [maf], [ld], npc, **options)


def tune_ld_npc_class(cohort: Cohort, maf: Range, ld: Sequence[float], npc: Sequence[int], algorithm: str = "svml", **options) -> Tuning:
    return tune_classifiers(cohort, [maf], ld, npc, [algorithm], **options)


def tune_maf_npc_class(cohort: Cohort, maf: Sequence[Range], npc: Sequence[int], ld: float = 0.2, algorithm: str = "svml", **options) -> Tuning:
    return tune_classifiers(cohort, maf, [ld], npc, [algorithm], start=(100.0, 100.0), **options)


def tune_maf_ld_class(cohort: Cohort, maf: Sequence[Range], ld: Sequence[float], npc: int = 5, algorithm: str = "svml", **options) -> Tuning:
    return tune_classifiers(cohort, maf, ld, [npc], [algorithm], **options)


def tune_maf_ld_npc_class(
    cohort: Cohort, maf: Sequence[Range], ld: Sequence[float], npc: Sequence[int], algorithm: str = "svml", **options
) -> Tuning:
    return tune_classifiers(cohort, maf, ld, npc, [algorithm], **options)
