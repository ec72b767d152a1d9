"""Least squares far from 0, with drift, flat and repeated covariates, against numpy on the values near 0."""

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import forecast as fc
from tidewatch.operators.forecast import covariate_forecast, covariates_forecast, least_squares

SCHEMA = "series_id string, split string, t long, feature string, value double"


def rows(columns, cut):
    n = len(next(iter(columns.values())))
    return [("s", "train" if i < cut else "test", i if i < cut else i - cut, f, None if v[i] is None else float(v[i])) for f, v in columns.items() for i in range(n)]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_an_exact_line_is_found_at_any_offset(spark, offset):
    """y = x / 2 + c exactly, in quarters so that the offset loses no digit."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(scale=1000, size=400) * 4) / 4 * 2
    other = np.round(rng.normal(scale=5, size=400) * 4) / 4
    y = x / 2 + 3
    df = spark.createDataFrame(rows({"y": y + offset, "x": x + offset, "z": other + offset}, 200), SCHEMA)
    for f in (covariate_forecast(df, "y", "x", 10), covariates_forecast(df, "y", 10)):
        got = {r.t: r.point for r in f.collect()}
        worst = max(abs(got[t] - offset - y[200 + t]) for t in range(200))
        assert worst / np.std(y) < 1e-6
        assert worst <= 4 * np.spacing(offset + 3000)


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_noisy_fits_equal_those_near_zero(spark, offset):
    """A drifting covariate, one a million times smaller, noise; every block's fit is numpy's on the values without the offset."""
    rng = np.random.default_rng(5)
    n, cut, h = 240, 60, 12
    quarter = lambda v: np.round(v * 4) / 4
    a, b = quarter(np.cumsum(rng.normal(size=n)) * 50), quarter(rng.normal(size=n) * 3)
    y = quarter(0.3 * a - 2 * b + rng.normal(size=n) * 10)
    df = spark.createDataFrame(rows({"y": y + offset, "a": a + offset, "b": b + offset}, cut), SCHEMA)
    got = {r.t: r.point for r in covariates_forecast(df, "y", h).collect()}
    one = {r.t: r.point for r in covariate_forecast(df, "y", "a", h).collect()}
    for t in range(n - cut):
        past = cut + t // h * h
        for found, x in ((got, np.column_stack([a, b])), (one, a[:, None])):
            design = np.column_stack([np.ones(past), x[:past]])
            beta = np.linalg.lstsq(design, y[:past], rcond=None)[0]
            assert abs(found[t] - offset - (beta[0] + x[cut + t] @ beta[1:])) < 1e-6 * np.std(y)


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_flat_and_repeated_covariates(spark, offset):
    """A constant covariate has no weight, two equal ones share theirs, a constant target is forecast as itself."""
    x = np.arange(60) * 0.25
    base = {"y": 2 * x + offset, "k": np.full(60, 7.1 + offset), "x1": x + offset, "x2": x + offset}
    got = {r.t: r.point for r in covariates_forecast(spark.createDataFrame(rows(base, 30), SCHEMA), "y", 6).collect()}
    assert max(abs(got[t] - offset - 2 * x[30 + t]) for t in range(30)) < 1e-5
    flat = spark.createDataFrame(rows({"y": np.full(60, 5.3 + offset), "x": x + offset}, 30), SCHEMA)
    assert all(abs(r.point - 5.3 - offset) < 1e-6 for r in covariates_forecast(flat, "y", 6).collect())
    still = spark.createDataFrame(rows({"y": x + offset, "x": np.full(60, 5.3 + offset)}, 30), SCHEMA)
    got = {r.t: r.point for r in covariate_forecast(still, "y", "x", 6).collect()}
    assert all(abs(got[t] - offset - x[: 30 + t // 6 * 6].mean()) < 1e-6 for t in range(30))


def test_blocks_before_the_first_pair(spark):
    """No step of the train split has both values: blocks have null points until one has."""
    y = [None] * 10 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    x = [1.0] * 10 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame(rows({"y": y, "x": x}, 10), SCHEMA)
    for f in (covariate_forecast(df, "y", "x", 4), covariates_forecast(df, "y", 4)):
        got = {r.t: r.point for r in f.collect()}
        assert [got[t] for t in range(4)] == [None] * 4
        assert all(abs(got[t] - (t + 1)) < 1e-9 for t in range(4, 8))


def test_stacked_solutions_equal_single_ones():
    rng = np.random.default_rng(1)
    m = []
    for _ in range(5):
        z = np.column_stack([np.ones(30), rng.normal(size=(30, 4))])
        m.append(z.T @ z)
    m = np.stack(m)
    together = least_squares(m, np.zeros((5, 4)))
    assert np.allclose(together, np.vstack([least_squares(m[i : i + 1], np.zeros((1, 4))) for i in range(5)]))


def test_products_of_several_series_in_one_batch():
    """Series of different sizes, mixed; a batch larger than it may hold at once."""
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", int(i % 5), rng.normal(size=1 + i % 3).tolist()) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.float64())))], ["series_id", "window_id", "d"])
    for limit in (1 << 22, 70):
        old, fc.PRODUCTS = fc.PRODUCTS, limit
        try:
            got = {}
            for part in fc._products(iter([batch])):
                for r in part.to_pylist():
                    got[r["series_id"], r["window_id"]] = got.get((r["series_id"], r["window_id"]), 0) + np.array(r["sums"])
        finally:
            fc.PRODUCTS = old
        assert len(got) == 15
        for (s, w), sums in got.items():
            x = np.array([[1.0, *d] for a, b, d in rows if (a, b) == (s, w)])
            assert np.allclose(sums, (x.T @ x)[np.triu_indices(x.shape[1])])


def test_several_targets_equal_each_alone(spark):
    """One set of sums for all targets; a series that lacks a target, one that has nothing but it, gaps."""
    rng = np.random.default_rng(8)
    full = {f: rng.normal(size=60) for f in ("a", "b", "c", "d")}
    full["a"] = 2 * full["b"] - full["c"] + 0.1 * full["a"]
    full["b"] = [None if i % 7 == 3 else v for i, v in enumerate(full["b"])]
    name = lambda s, columns: [(s, *r[1:]) for r in rows(columns, 20)]
    data = name("s", full) + name("t", {k: full[k] for k in ("b", "c", "d")}) + name("u", {"a": full["a"]})
    df = spark.createDataFrame(data, SCHEMA)
    key = lambda r: (r.feature, r.series_id, r.window_id, r.t)
    got = {key(r): (r.y, r.point) for r in fc.covariates_forecasts(df, ["a", "b"], 8).collect()}
    assert {k[:2] for k in got} == {("a", "s"), ("b", "s"), ("a", "t"), ("b", "t"), ("b", "u")} and len(got) == 200
    assert all(v == (None, None) for k, v in got.items() if k[:2] in (("a", "t"), ("b", "u")))
    for (feature, series, w, t), (y, point) in got.items():
        others = [c for c in ("a", "b", "c", "d") if c != feature and (c != "a" or series == "s")]
        x = np.array([full[c] for c in others], float).T
        if (feature, series) in (("a", "t"), ("b", "u")):
            continue
        target = np.array(full[feature], float)
        assert (y is None and np.isnan(target[20 + t])) or y == target[20 + t]
        known = np.isfinite(x).all(axis=1) & np.isfinite(target)
        past = known & (np.arange(60) < 20 + w * 8)
        beta = np.linalg.lstsq(np.column_stack([np.ones(past.sum()), x[past]]), target[past], rcond=None)[0]
        want = beta[0] + x[20 + t] @ beta[1:]
        assert (point is None and np.isnan(want)) or abs(point - want) < 1e-8
