"""Scalar expressions on one genotype call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demescope.schema import ALT, OTHER_ALT, REF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dosage_alt_only(alleles: Column | str) -> Column:
    """0, 1 or 2 copies of ``Alt`` among the first two alleles; null without alleles."""
    a = _col(alleles)
    first, second = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    copies = F.when(first == ALT, 1).otherwise(0) + F.when(second == ALT, 1).otherwise(0)
    return F.when(a.isNotNull(), copies).cast("int")


def dosage_non_ref(alleles: Column | str) -> Column:
    """Number of alleles other than ``Ref``, at any ploidy."""
    a = _col(alleles)
    return F.when(a.isNotNull(), F.size(F.filter(a, lambda x: x != REF))).cast("int")


ENCODERS = {"alt_only": dosage_alt_only, "non_ref": dosage_non_ref}


def dosage(alleles: Column | str, encoder: str = "alt_only") -> Column:
    if encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}; one of {sorted(ENCODERS)}")
    return ENCODERS[encoder](alleles)


def has_known_allele(alleles: Column | str) -> Column:
    """False only where both alleles are ``OtherAlt``."""
    a = _col(alleles)
    return (F.get(a, F.lit(0)) != OTHER_ALT) | (F.get(a, F.lit(1)) != OTHER_ALT)


def is_snv(ref: Column | str, alt: Column | str) -> Column:
    """One base replaced by one base."""
    return (F.length(_col(ref)) == 1) & (F.length(_col(alt)) == 1)


def variant_id(contig: Column | str, start: Column | str, end: Column | str | None = None) -> Column:
    """``contig:start`` or ``contig:start:end``."""
    parts = [_col(contig), _col(start).cast("string")]
    if end is not None:
        parts.append(_col(end).cast("string"))
    return F.concat_ws(":", *parts)


def pack_genotype(sample_id: Column | str, dosage_: Column | str) -> Column:
    """``sample:dosage`` text as kept in summary tables."""
    return F.concat(_col(sample_id), F.lit(":"), _col(dosage_).cast("string"))


def unpack_genotypes(packed: Column | str) -> Column:
    """Array of ``sample:dosage`` texts to an array of structs ordered by sample.

    The dosage follows the last colon, so sample names may hold colons.
    """

    def one(text: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, r"^(.*):([^:]*)$", 1).alias("sample_id"),
            F.regexp_extract(text, r"^(.*):([^:]*)$", 2).cast("int").alias("dosage"),
        )

    return F.array_sort(F.transform(_col(packed), one))
