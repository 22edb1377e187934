"""From dosages to a pruned, labelled and reduced cohort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demescope.operators import ld as linkage
from demescope.operators import qc, reduce, reshape
from demescope.schema import VARIANT
from demescope.session import cut_lineage
from demescope.sources.writers import write_genotype_subset, write_snp_panel

MAX_BP = 500_000


@dataclass
class Cohort:
    """Dosages numbered once, with the frequency table every later step reads.

    ``cells``: sample_id, sample_no, contig, pos, alleles, snp_idx, dosage (written out).
    ``variants``: snp_idx, VARIANT, nonmissing, n_samples, af, maf, missing_rate (written out).
    """

    cells: DataFrame
    variants: DataFrame
    regions: DataFrame

    @classmethod
    def of(cls, dosages: DataFrame, regions: DataFrame, approx_size: bool = False) -> Cohort:
        """Keeps the samples of ``regions`` only, as frequencies refer to them."""
        kept = cut_lineage(qc.keep_samples(dosages, regions))
        cells = cut_lineage(linkage.number_cells(kept))
        n = cells.agg((F.max("sample_no") + 1).alias("n"))
        rates = qc.variant_summary(cells, n, snv_only=False)
        numbers = cells.select("snp_idx", *VARIANT).distinct()
        sized = rates.join(numbers, VARIANT).withColumn("n_samples", qc.size_column(n))
        return cls(cells, cut_lineage(sized), regions)

    def chosen(
        self, min_maf: float, max_maf: float, missing_rate: float = 1.0, bounds: str = "strict"
    ) -> DataFrame:
        """Variants in the frequency range with at most the missing rate."""
        inside = qc.frequency_between(self.variants, min_maf, max_maf, "maf", bounds)
        return inside.filter(qc.enough_calls(F.col("nonmissing"), F.col("n_samples"), missing_rate))

    def restrict(self, snps: DataFrame) -> DataFrame:
        return self.cells.join(snps.select("snp_idx"), "snp_idx", "left_semi")

    def pairs(self, snps: DataFrame, method: str = "composite", max_bp: int = MAX_BP, max_n: int | None = None) -> DataFrame:
        """Linkage of the listed variants, written out."""
        return cut_lineage(linkage.ld_pairs(self.restrict(snps), method, max_bp, max_n))

    def pruned(self, snps: DataFrame, pairs: DataFrame, threshold: float, start_idx: int | None = None) -> DataFrame:
        """Listed variants left at a threshold; ``pairs`` may cover more variants than listed."""
        names = snps.select("snp_idx")
        inside = pairs.join(names.toDF("idx_a"), "idx_a", "left_semi").join(names.toDF("idx_b"), "idx_b", "left_semi")
        kept = linkage.ld_prune(inside, snps, threshold, start_idx)
        return snps.join(kept.select("snp_idx"), "snp_idx", "left_semi")


def snp_panel(
    cohort: Cohort,
    min_maf: float = 0.005,
    max_maf: float = 0.05,
    ld: float = 0.2,
    missing_rate: float = 1.0,
    max_bp: int = MAX_BP,
    method: str = "composite",
    path: str | None = None,
) -> DataFrame:
    """Variants left after frequency, completeness and linkage filters; optionally written as CSV."""
    snps = cohort.chosen(min_maf, max_maf, missing_rate)
    kept = cut_lineage(cohort.pruned(snps, cohort.pairs(snps, method, max_bp), ld))
    if path is not None:
        write_snp_panel(kept, path)
    return kept


def qc_cells(cohort: Cohort, **filters) -> DataFrame:
    """Long dosages of the selected variants with regions."""
    return qc.label_regions(cohort.restrict(snp_panel(cohort, **filters)), cohort.regions)


def qc_matrix(cohort: Cohort, **filters) -> DataFrame:
    """One labelled dosage vector per sample over the selected variants."""
    return reshape.sample_vectors(cohort.restrict(snp_panel(cohort, **filters)), cohort.regions)


def qc_subset(cohort: Cohort, path: str, **filters) -> None:
    """Writes the dosages of the selected variants."""
    chosen = snp_panel(cohort, **filters)
    columns = ["sample_id", *VARIANT, "dosage"]
    write_genotype_subset(cohort.cells.select(*columns), path, variants=chosen)


def qc_pca(cohort: Cohort, npc: int = 4, **filters) -> tuple[DataFrame, DataFrame]:
    """Labelled components ``(sample_id, region, features)`` and the eigenvalue report."""
    scores, values = reduce.sample_pca(cohort.restrict(snp_panel(cohort, **filters)), npc)
    return reduce.labelled(scores, cohort.regions), reduce.eigenvalue_table(values)


def matrix_from_panel(
    calls: DataFrame,
    panel: DataFrame,
    regions: DataFrame,
    times: int = 1,
    by: Sequence[str] = ("contig", "pos"),
) -> DataFrame:
    """Calls at the positions of a stored panel (contigName, start) to labelled, replicated dosages."""
    spots = panel.select(F.col("contigName").alias("contig"), F.col("start").alias("pos"))
    here = qc.keep_variants(calls, spots, list(by))
    sums = qc.sample_dosage(here, by_site=True)
    return qc.replicate(qc.label_regions(sums, regions), times)
