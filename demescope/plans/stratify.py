"""The whole study: calls and panel in, clusters and classes out."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.functions.alleles import has_known_allele
from demescope.functions.ld_measures import METHODS
from demescope.operators import classify, cluster, cluster_metrics, distance, outliers, qc, reduce, reshape
from demescope.operators.class_metrics import mean_metrics
from demescope.plans.quality import MAX_BP, Cohort
from demescope.session import cut_lineage

REDUCTIONS = ("PCA", "MDS", None)
CLASSIFICATIONS = ("svm", "dt", "rf", None)


@dataclass
class Study:
    """Tables of a run; a stage that was switched off leaves its entry None."""

    variants: DataFrame | None = None
    outliers: DataFrame | None = None
    samples: DataFrame | None = None
    clusters: DataFrame | None = None
    cluster_metrics: DataFrame | None = None
    class_metrics: DataFrame | None = None
    seconds: list[tuple[str, float]] = field(default_factory=list)

    def timings(self) -> DataFrame:
        spark = self.samples.sparkSession
        return spark.createDataFrame(self.seconds, "stage string, seconds double")


def _check(**shares: float) -> None:
    for name, value in shares.items():
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"{name} must lie in 0..1")


def stratify(
    calls: DataFrame,
    panel: DataFrame,
    populations: Sequence[str] | None = None,
    missing_rate: float = 0.0,
    frequencies: bool = True,
    min_freq: float = 0.0,
    max_freq: float = 1.0,
    measure: str = "mean_dosage",
    prune: bool = True,
    ld_method: str = "composite",
    ld_threshold: float = 0.2,
    ld_max_bp: int = MAX_BP,
    ld_max_n: int | None = None,
    find_outliers: bool = False,
    reduction: str | None = "PCA",
    npc: int = 20,
    variance: float = 0.7,
    mds_metric: str = "euclidean",
    mds_p: float = 2,
    clustering: str | None = "kmeans",
    n_clusters: int | None = None,
    tune_clusters: bool = False,
    classification: str | None = None,
    cv: bool = False,
    repeats: int = 1,
    folds: int = 10,
) -> Study:
    """Quality control, pruning, outliers, reduction, clustering and classification in turn.

    ``calls`` are flat calls with ``alleles`` and ``dosage``; ``panel`` is ``(sample_id, region)``.
    """
    _check(missing_rate=missing_rate, ld_threshold=ld_threshold, variance=variance)
    if ld_method not in METHODS:
        raise ValueError(f"ld_method must be one of {METHODS}")
    if reduction not in REDUCTIONS or classification not in CLASSIFICATIONS:
        raise ValueError(f"reduction: {REDUCTIONS}; classification: {CLASSIFICATIONS}")
    if clustering is not None and clustering not in cluster.ALGORITHMS:
        raise ValueError(f"clustering must be one of {sorted(cluster.ALGORITHMS)}")
    if min_freq < 0 or max_freq < 0 or ld_max_bp < 0 or (ld_max_n or 0) < 0:
        raise ValueError("frequencies and windows must not be negative")
    study = Study()

    def timed(stage: str, work):
        start = time.time()
        out = work()
        study.seconds.append((stage, time.time() - start))
        return out

    regions = panel if populations is None else panel.filter(F.col("region").isin(list(populations)))

    def quality() -> Cohort:
        known = calls.filter(has_known_allele("alleles") & (F.length("ref_allele") == 1) & (F.length("alt_allele") == 1))
        return Cohort.of(known.drop("alleles"), regions)

    cohort = timed("frequencies", quality)
    low, high = (min_freq, max_freq) if frequencies else (0.0, 1.0)
    # A site is judged by all its alternates, before rare ones are filtered out.
    chosen = qc.frequency_between(qc.biallelic(cohort.variants), low, high, measure)
    chosen = chosen.filter(qc.enough_calls(F.col("nonmissing"), F.col("n_samples"), missing_rate))
    if prune:
        pairs = timed("linkage", lambda: cohort.pairs(chosen, ld_method, ld_max_bp, ld_max_n))
        chosen = timed("pruning", lambda: cut_lineage(cohort.pruned(chosen, pairs, ld_threshold)))
    study.variants = chosen
    cells = timed("selection", lambda: cut_lineage(cohort.restrict(chosen)))
    if find_outliers:
        study.outliers = timed("outliers", lambda: cut_lineage(outliers.outlier_samples(qc.sample_stats(cells))))
        cells = qc.drop_samples(cells, study.outliers)

    def reduced() -> DataFrame:
        if reduction == "MDS":
            pairs_ = distance.sample_distances(cells, mds_metric, mds_p, rescale=True, listed=False)
            n = cells.agg(F.max("sample_no") + 1).first()[0]
            names = cells.select("sample_id", "sample_no").distinct()
            scores = reduce.classical_mds(pairs_, n, npc, variance).join(names, "sample_no")
            return reduce.labelled(scores, regions)
        if reduction == "PCA":
            return reduce.labelled(reduce.sample_pca_scaled(cells, npc, variance), regions)
        return reshape.sample_vectors(cells, regions)

    study.samples = timed("reduction", lambda: cut_lineage(reduced()))
    if clustering is not None:
        k = n_clusters or regions.select("region").distinct().count()
        if tune_clusters:
            scores = timed("cluster count", lambda: cluster.tune_k(study.samples, clustering, (2, 3, 4, 5), repeats))
            k = cluster.best_k(scores).first()["k"]
        study.clusters = timed("clustering", lambda: cut_lineage(cluster.ALGORITHMS[clustering](study.samples, k)[0]))
        study.cluster_metrics = timed("cluster metrics", lambda: cut_lineage(cluster_metrics.cluster_metrics(study.clusters)))
    if classification is not None:
        fit = {
            "svm": (lambda df: classify.svm_cv(df, folds=folds)) if cv else classify.svm,
            "dt": lambda df: classify.decision_tree(df, cv=cv, folds=folds),
            "rf": lambda df: classify.random_forest(df, cv=cv, folds=folds),
        }[classification]
        runs = timed("classification", lambda: classify.repeated_metrics(study.samples, fit, repeats))
        study.class_metrics = mean_metrics(runs, ["split"])
    return study


def components_and_clusters(vectors: DataFrame, k: int = 5, npc: int = 5) -> tuple[DataFrame, DataFrame]:
    """Components, then k-means on them: predictions and the seconds of both stages."""
    start = time.time()
    scores = cut_lineage(reduce.pca_features(vectors, npc)[0])
    middle = time.time()
    found = cut_lineage(cluster.kmeans(scores, k)[0])
    end = time.time()
    timings = vectors.sparkSession.createDataFrame(
        [("pca", middle - start), ("kmeans", end - middle)], "stage string, seconds double"
    )
    return found, timings


class Population:
    """Frequencies, filters and matrices of one set of calls, step by step.

    Each step returns a new object; nothing runs before a table is read.
    """

    def __init__(self, calls: DataFrame, panel: DataFrame, chosen: DataFrame | None = None):
        self.calls, self.panel, self.chosen = calls, panel, chosen

    def frequencies(self) -> DataFrame:
        """Carrier frequency and mean dosage per variant."""
        known = self.calls
        carriers = qc.carrier_frequency(known)
        totals = qc.allele_totals(known)
        return carriers.join(totals, ["contig", "pos", "ref_allele", "alt_allele"])

    def with_carriers(self, low: float, high: float, missing_rate: float = 0.0) -> Population:
        """Keeps variants by carrier frequency and completeness."""
        n = qc.cohort_size(self.calls)
        kept = qc.frequency_between(self.frequencies().withColumnRenamed("n_calls", "nonmissing"), low, high, "carrier_frequency")
        return Population(self.calls, self.panel, qc.complete(kept, n, missing_rate))

    def selected(self) -> DataFrame:
        return self.calls if self.chosen is None else qc.keep_variants(self.calls, self.chosen)

    def long(self) -> DataFrame:
        """Labelled dosages of the selected variants."""
        return qc.label_regions(qc.sample_dosage(self.selected()), self.panel)

    def matrix(self) -> DataFrame:
        """One labelled vector per sample."""
        rows = cut_lineage(qc.sample_dosage(self.selected()))
        index = reshape.snp_index(rows.select("contig", "pos", "ref_allele", "alt_allele").distinct())
        return reshape.sample_vectors(rows.join(index, ["contig", "pos", "ref_allele", "alt_allele"]), self.panel)
