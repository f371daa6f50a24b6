"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 2) -> Column:
    """Half up towards positive infinity, as scores are compared."""
    unit = float(10**digits)
    return F.floor(value * unit + 0.5) / unit


def noisy_or(values: Column) -> Column:
    """100 * (1 - prod(1 - v / 100)) over an array of values clamped to 0..100."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0))
    return F.aggregate(values, F.lit(1.0), lambda acc, v: acc * (1 - clamp(v) / 100), lambda acc: 100 * (1 - acc))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the union of two arrays without repeats; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two arrays without repeats; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def reciprocal_rank_fusion(*ranks: Column, k: int = 60) -> Column:
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.lit(1.0) / (r + k)
    return rounded(total * 1000)


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))
