"""Distances of vectors (DV-1 .. DV-3, FN-35, FN-40) and small schedules (FN-37 .. FN-39) on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """DV-1: 1 - cosine, clipped; a zero vector is at distance 1 from everything."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(c, F.lit(0.0))))


def l1_distance(a: Column, b: Column) -> Column:
    """DV-2: sum of absolute differences."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l1_normalized(a: Column) -> Column:
    """FN-35: divided by the sum of absolute values; zeros stay zeros."""
    s = total(F.transform(a, lambda x: F.abs(x)))
    return F.transform(a, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))


def distribution(a: Column, eps: float) -> Column:
    """The vector plus eps, as shares."""
    b = F.transform(a, lambda x: x + F.lit(eps))
    s = total(b)
    return F.transform(b, lambda x: x / s)


def kl_divergence(p: Column, q: Column) -> Column:
    """FN-40: sum of p (ln p - ln q)."""
    return total(F.zip_with(p, q, lambda x, y: x * (F.ln(x) - F.ln(y))))


def js_distance(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """DV-3: root of the Jensen-Shannon divergence in natural logarithms."""
    p, q = distribution(a, eps), distribution(b, eps)
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), (kl_divergence(p, m) + kl_divergence(q, m)) / 2))


def reliability(n: Column, full: int = 5) -> Column:
    """FN-37: min(1, n / full)."""
    return F.least(F.lit(1.0), n / F.lit(float(full)))


def seed_quota(total_images: Column, static: int = 3, fraction: float = 0.15, rare: int = 15) -> Column:
    """FN-38: images of a rare class that a split is seeded with, never all of them; 0 for other classes."""
    small = F.least(F.lit(static), F.greatest(F.lit(1), F.ceil(total_images * fraction).cast("int")))
    return F.when(total_images < rare, F.greatest(F.lit(0), F.least(small, total_images.cast("int") - 1))).otherwise(F.lit(0))


def weight_schedule(epoch: Column, top: float, start: int = 30, end: int = 80) -> Column:
    """FN-39: 0 before ``start``, linear up to ``end``, then ``top``."""
    return F.when(epoch < start, 0.0).when(epoch >= end, top).otherwise(top * (epoch - start) / (end - start))
