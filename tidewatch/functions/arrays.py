"""Statistics of numeric array columns, and rounding; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def quantile(ordered: Column, p: float) -> Column:
    """Quantile of an ascending array, linear between neighbours; null for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def weighted(a: Column, weights: Column) -> Column:
    return total(F.zip_with(a, weights, lambda x, w: x * w))


def rounded_to(x: Column, digits: int) -> Column:
    """``x`` to so many digits as SQL engines on binary doubles do it: the product with 10^digits, to the nearest integer (halves away from 0), divided again.

    ``F.round`` rounds the shortest decimal that reads as ``x``. The two differ where that ends in a 5 that the double lies below, as 0.621875 does.
    """
    power = F.lit(float(10**digits))
    return F.round(x * power) / power
