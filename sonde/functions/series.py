"""Array maths over one bounded series (a resampled window, never a raw key group)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def at(a: Column, i) -> Column:
    """Zero-based element, null outside."""
    return F.get(a, i if isinstance(i, Column) else F.lit(i))


def quantile_sorted(s: Column, p: float) -> Column:
    """Linear-interpolation quantile of an ascending array; null when empty."""
    pos = (F.size(s) - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    return at(s, lo) + (at(s, hi) - at(s, lo)) * (pos - lo)


def median(a: Column) -> Column:
    return quantile_sorted(F.array_sort(a), 0.5)


def mad(a: Column, centre: Column) -> Column:
    return median(F.transform(a, lambda x: F.abs(x - centre)))


def change_rates(a: Column, eps: float) -> Column:
    """|x_i - x_(i-1)| / (|x_(i-1)| + eps) for i >= 1."""
    tail = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    head = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda b, c: F.abs(b - c) / (F.abs(c) + eps))
