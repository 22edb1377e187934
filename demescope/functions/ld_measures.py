"""Linkage disequilibrium of two variants from their 3x3 table of joint dosages.

Columns ``n00 .. n22``: samples with dosage x at the first and y at the second variant, both called.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = [f"n{x}{y}" for x in range(3) for y in range(3)]
METHODS = ("composite", "corr", "r", "dprime")

# Fixed values of the haplotype iteration: pseudo-count, step limit, machine epsilon.
EM_PSEUDO_COUNT = 0.01
EM_MAX_STEPS = 999
EM_EPSILON = 2.0**-52


def _n(x: int, y: int) -> Column:
    return F.col(f"n{x}{y}").cast("double")


def _total(weight) -> Column:
    """Sum over the nine cells of ``weight(x, y)`` times the count."""
    terms = [_n(x, y) * float(weight(x, y)) for x in range(3) for y in range(3) if weight(x, y)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def valid_pairs() -> Column:
    return _total(lambda x, y: 1)


def correlation() -> Column:
    """Pearson correlation of the dosages; null where either variant does not vary."""
    n = valid_pairs()
    sx, sy = _total(lambda x, y: x), _total(lambda x, y: y)
    var = (_total(lambda x, y: x * x) - sx * sx / n) * (_total(lambda x, y: y * y) - sy * sy / n)
    cov = _total(lambda x, y: x * y) - sx * sy / n
    return F.when((n > 0) & (F.when(n > 0, var) > 0), cov / F.sqrt(var))


def composite() -> Column:
    """Composite genotypic disequilibrium, scaled by the genotypic variances.

    Half the covariance over half the geometric mean of the variances, hence the same
    number as ``correlation``; kept apart as the named default measure.
    """
    n = valid_pairs()
    hom_x = _total(lambda x, y: x == 0) - _total(lambda x, y: x == 2)
    hom_y = _total(lambda x, y: y == 0) - _total(lambda x, y: y == 2)
    delta = (_n(2, 2) + _n(0, 0) - _n(0, 2) - _n(2, 0)) / (2.0 * n) - hom_x * hom_y / (2.0 * n * n)

    def spread(side) -> Column:
        p0 = (2.0 * _total(lambda x, y: side(x, y) == 0) + _total(lambda x, y: side(x, y) == 1)) / (2.0 * n)
        p1 = 1.0 - p0
        return p1 * p0 + _total(lambda x, y: side(x, y) == 2) / n - p1 * p1

    t = spread(lambda x, y: x) * spread(lambda x, y: y)
    return F.when((n > 0) & (F.when(n > 0, t) > 0), delta / F.sqrt(t))


# Haplotypes each genotype pair carries for certain; (1, 1) is the ambiguous pair.
# Copies of the haplotype per (x, y).
HAPLOTYPES = {
    "AA": {(2, 2): 2, (2, 1): 1, (1, 2): 1},
    "AB": {(2, 0): 2, (2, 1): 1, (1, 0): 1},
    "BA": {(0, 2): 2, (0, 1): 1, (1, 2): 1},
    "BB": {(0, 0): 2, (0, 1): 1, (1, 0): 1},
}


def haplotype_counts() -> list[Column]:
    """hAA, hAB, hBA, hBB and hDH2 (twice the double heterozygotes)."""
    sure = [
        _total(lambda x, y, copies=copies: copies.get((x, y), 0)).alias(f"h{name}")
        for name, copies in HAPLOTYPES.items()
    ]
    return [*sure, (_n(1, 1) * 2.0).alias("hDH2")]


HAPLOTYPE_SHARES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("pAA", "pAB", "pBA", "pBB")])


@F.pandas_udf(HAPLOTYPE_SHARES)
def haplotype_shares(aa: pd.Series, ab: pd.Series, ba: pd.Series, bb: pd.Series, dh2: pd.Series) -> pd.DataFrame:
    """Haplotype proportions by expectation-maximisation, a whole batch of pairs at once."""
    counts = np.stack([c.to_numpy(dtype=float) for c in (aa, ab, ba, bb)], axis=1)
    double_het = dh2.to_numpy(dtype=float) / 2.0
    total = counts.sum(axis=1) + 2.0 * double_het
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / total[:, None]
        start = (counts + EM_PSEUDO_COUNT) / (counts.sum(axis=1) + 4 * EM_PSEUDO_COUNT)[:, None]
    active = np.flatnonzero((total > 0) & (double_het > 0))
    p[active] = start[active]

    def log_likelihood(rows):
        return (counts[rows] * np.log(p[rows] + EM_EPSILON)).sum(axis=1)

    last = log_likelihood(active)
    tolerance = np.maximum(np.abs(math.sqrt(EM_EPSILON) * last), EM_EPSILON)
    for _ in range(EM_MAX_STEPS):
        if not len(active):
            break
        q = p[active]
        same, cross = q[:, 0] * q[:, 3], q[:, 1] * q[:, 2]
        f = same / (same + cross)
        share = np.stack([f, 1.0 - f, 1.0 - f, f], axis=1) * double_het[active, None]
        p[active] = (counts[active] + share) / total[active, None]
        now = log_likelihood(active)
        going = np.abs(last - now) > tolerance
        active, last, tolerance = active[going], now[going], tolerance[going]
    return pd.DataFrame(p, columns=["pAA", "pAB", "pBA", "pBB"])


def haplotype_r(h: Column) -> Column:
    """Correlation of the two alleles on a haplotype."""
    a1, a2 = h["pAA"] + h["pAB"], h["pAA"] + h["pBA"]
    b1, b2 = h["pBB"] + h["pBA"], h["pBB"] + h["pAB"]
    t = a1 * a2 * b1 * b2
    return F.when(t > 0, (h["pAA"] - a1 * a2) / F.sqrt(t))


def haplotype_dprime(h: Column) -> Column:
    """Disequilibrium as a share of its possible maximum, unsigned."""
    a1, a2 = h["pAA"] + h["pAB"], h["pAA"] + h["pBA"]
    b1, b2 = h["pBB"] + h["pBA"], h["pBB"] + h["pAB"]
    d = h["pAA"] - a1 * a2
    limit = F.when(d >= 0, F.least(a1 * b2, b1 * a2)).otherwise(F.greatest(-a1 * a2, -b1 * b2))
    return F.when(limit != 0, d / limit)


def with_haplotypes(pairs: DataFrame) -> DataFrame:
    """Adds the struct column ``hap`` with the haplotype proportions."""
    named = pairs.select("*", *haplotype_counts())
    shares = haplotype_shares("hAA", "hAB", "hBA", "hBB", "hDH2")
    return named.withColumn("hap", shares).drop("hAA", "hAB", "hBA", "hBB", "hDH2")


def with_ld(pairs: DataFrame, method: str = "composite") -> DataFrame:
    """Adds ``ld`` by the named measure; null where it is undefined."""
    if method == "composite":
        return pairs.withColumn("ld", composite())
    if method == "corr":
        return pairs.withColumn("ld", correlation())
    if method in ("r", "dprime"):
        measure = haplotype_r if method == "r" else haplotype_dprime
        with_hap = with_haplotypes(pairs)
        return with_hap.withColumn("ld", measure(F.col("hap"))).drop("hap")
    raise ValueError(f"method must be one of {METHODS}")
