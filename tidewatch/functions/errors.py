"""Gap between actual and forecast as column expressions, chosen by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8
#: Half the width of a normal distribution's 10-90 % band in standard deviations.
BAND_HALF_WIDTH = 1.28


def squared(y: Column, point: Column, low: Column | None = None, high: Column | None = None) -> Column:
    return (y - point) * (y - point)


def interval(y: Column, point: Column, low: Column, high: Column) -> Column:
    """How far the actual lies outside the band."""
    return F.greatest(y - high, F.lit(0.0)) + F.greatest(low - y, F.lit(0.0))


def normalized_deviation(y: Column, point: Column, low: Column, high: Column) -> Column:
    return F.abs(y - point) / (high - low + EPSILON)


def smape(y: Column, point: Column, low: Column | None = None, high: Column | None = None) -> Column:
    return 2 * F.abs(y - point) / (F.abs(y) + F.abs(point) + EPSILON)


SCORES: dict[str, Callable[..., Column]] = {"mse": squared, "interval": interval, "normalized_deviation": normalized_deviation, "smape": smape}
DEFAULT_SCORE = "interval"


def score(name: str, y: Column, point: Column, low: Column, high: Column) -> Column:
    """The named score; ValueError for an unknown name."""
    if name not in SCORES:
        raise ValueError(f"unknown score method {name!r}; known: {', '.join(SCORES)}")
    return SCORES[name](y, point, low, high)


def uncertainty(low: Column, high: Column) -> Column:
    """Standard deviation that the band suggests, at least 0.001; 1 without a band."""
    width = high - low
    return F.when(width.isNull(), F.lit(1.0)).otherwise(F.greatest(width / (2 * BAND_HALF_WIDTH), F.lit(1e-3)))


def in_deviations(y: Column, point: Column, low: Column, high: Column) -> Column:
    """|y - point| in standard deviations that the band suggests."""
    return F.abs(y - point) / uncertainty(low, high)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
