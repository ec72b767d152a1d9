"""Bands from a method's own errors within the context: values against a plain loop, and coverage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.forecast import RESIDUALS, forecast
from tidewatch.operators.windows import sliding_windows

SCHEMA = "series_id string, split string, t long, feature string, value double"


def make(spark, values):
    return spark.createDataFrame([("s", "test", i, "f", float(v)) for i, v in enumerate(values)], SCHEMA)


def errors(x, method, alpha=0.3, season=3):
    if method == "ses":
        level, out = x[0], []
        for v in x[1:]:
            out.append(v - level)
            level = alpha * v + (1 - alpha) * level
        return out
    if method == "drift":
        return [x[i] - x[i - 1] - ((x[i - 1] - x[0]) / (i - 1) if i > 1 else 0) for i in range(1, len(x))]
    lag = season if method == "seasonal_naive" else 1
    return [x[i] - x[i - lag] for i in range(lag, len(x))]


def wider(method, k, n, alpha=0.3, season=3):
    return math.sqrt({"naive_last": k, "seasonal_naive": (k - 1) // season + 1, "drift": k * (1 + k / (n - 1)), "ses": 1 + (k - 1) * alpha**2}[method])


@pytest.mark.parametrize("method", sorted(RESIDUALS))
def test_bands_equal_a_plain_loop(spark, method):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=40)).tolist()
    f = forecast(sliding_windows(make(spark, x), 12, 5).drop("value"), method, 12, 5, alpha=0.3, season=3)
    for r in f.collect():
        ctx = x[r.origin - 12 : r.origin]
        want = r.point + np.quantile(errors(ctx, method), [0.1, 0.5, 0.9]) * wider(method, r.step, 12)
        assert np.allclose([r.q10, r.q50, r.q90], want)


def coverage(spark, values, method, context, **options):
    f = forecast(sliding_windows(make(spark, values), context, 6).drop("value"), method, context, 6, **options)
    inside = F.avg(((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("int"))
    return {r.step: r.c for r in f.where("origin % 5 = 0").groupBy("step").agg(inside.alias("c")).collect()}


def test_coverage_is_near_four_fifths(spark):
    rng = np.random.default_rng(11)
    walk, noise = np.cumsum(rng.normal(size=6000)), rng.normal(size=6000)
    level = np.cumsum(0.3 * rng.normal(size=6000)) + rng.normal(size=6000)
    wave = np.sin(np.arange(6000) * 2 * np.pi / 24) * 20 + noise
    for values, method, options in ((walk, "naive_last", {}), (walk + 0.5 * np.arange(6000), "drift", {}), (level, "ses", {"alpha": 0.3}), (wave, "seasonal_naive", {"season": 24})):
        got = coverage(spark, values, method, 96, **options)
        assert all(0.73 < c < 0.87 for c in got.values()), (method, got)


def test_a_trend_is_no_spread(spark):
    """A line without noise: drift's band has no width, where the context's own quantiles would give it most of the line's rise."""
    f = forecast(sliding_windows(make(spark, [3.0 * i for i in range(60)]), 20, 4).drop("value"), "drift", 20, 4)
    # the first error of each context is that of a line through one value
    assert all(abs(r.q90 - r.q10) < 1e-6 and abs(r.y - r.point) < 1e-9 for r in f.collect())


def test_a_context_without_errors_keeps_its_own_quantiles(spark):
    f = forecast(sliding_windows(make(spark, [5.0, 1.0, 2.0, 7.0, 3.0, 4.0]), 3, 2).drop("value"), "seasonal_naive", 3, 2, season=3)
    for r in f.collect():
        ctx = [5.0, 1.0, 2.0, 7.0, 3.0, 4.0][r.origin - 3 : r.origin]
        low, mid, high = np.quantile(ctx, [0.1, 0.5, 0.9])
        assert np.allclose([r.q10, r.q50, r.q90], [low - mid + r.point, r.point, high - mid + r.point])
    one = forecast(sliding_windows(make(spark, [5.0, 1.0]), 3, 1, least=1, partial=True).drop("value"), "ses", 3, 1)
    assert [(r.q10, r.q50, r.q90) for r in one.collect()] == [(5.0, 5.0, 5.0)]
