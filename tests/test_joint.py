"""Joint forecasts against numpy, and against single ones where features lead each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.forecast import forecast
from tidewatch.operators.joint import joint_forecast
from tidewatch.operators.windows import sliding_windows
from tidewatch.plans import pipelines as pl

SCHEMA = "series_id string, split string, t long, feature string, value double"


def long(data, cut, name="s"):
    return [(name, "train" if i < cut else "test", i if i < cut else i - cut, f, None if v[i] is None else float(v[i])) for f, v in data.items() for i in range(len(v))]


def leading(n, seed=0):
    """b follows a by one step, c is minus b two steps before; a is noise."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    b = np.concatenate(([0.0], 0.9 * a[:-1])) + 0.1 * rng.normal(size=n)
    c = -np.concatenate(([0.0, 0.0], b[:-2])) + 0.1 * rng.normal(size=n)
    return {"a": a, "b": b, "c": c}


def numpy_joint(data, cut, lags, ridge, horizon):
    """{(origin, step, feature): point} of the test split."""
    names = sorted(data)
    v = np.column_stack([data[f] for f in names])
    train, test = v[:cut], v[cut:]
    z = np.stack([np.concatenate([train[t - j] for j in range(1, lags + 1)]) for t in range(lags, cut)])
    y = train[lags:]
    zm, ym = z.mean(0), y.mean(0)
    sd = z.std(0)
    zs = (z - zm) / sd
    w = np.linalg.solve(zs.T @ zs / len(z) + ridge * np.eye(z.shape[1]), zs.T @ (y - ym) / len(z))
    out = {}
    for t in range(lags, len(test) - horizon + 1):
        past = [test[t - j] for j in range(1, lags + 1)]
        for step in range(1, horizon + 1):
            point = ym + ((np.concatenate(past[:lags]) - zm) / sd) @ w
            out.update({(t, step, f): point[i] for i, f in enumerate(names)})
            past = [point, *past]
    return out


@pytest.mark.parametrize(("lags", "ridge", "offset"), [(1, 0.01, 0.0), (3, 0.5, 0.0), (2, 0.1, 1e9)])
def test_points_equal_numpy(spark, lags, ridge, offset):
    data = leading(140, 3)
    rows = long({f: v + offset for f, v in data.items()}, 80)
    got = joint_forecast(spark.createDataFrame(rows, SCHEMA), 3, lags=lags, ridge=ridge, block=32).where("split = 'test'").collect()
    want = numpy_joint({f: (v + offset) - offset for f, v in data.items()}, 80, lags, ridge, 3)
    assert {(r.origin, r.step, r.feature) for r in got} == set(want)
    assert all(abs(r.point - offset - want[r.origin, r.step, r.feature]) < (1e-9 if not offset else 1e-6) for r in got)
    assert all(r.t == r.origin + r.step - 1 and abs(r.y - offset - data[r.feature][80 + r.t]) < 1e-6 for r in got)


def test_it_beats_single_forecasts_where_features_lead(spark):
    rows = long(leading(900, 5), 500)
    df = spark.createDataFrame(rows, SCHEMA)
    error = lambda f: {r.feature: r.e for r in f.where("split = 'test'").groupBy("feature").agg(F.avg((F.col("y") - F.col("point")) ** 2).alias("e")).collect()}
    joint = joint_forecast(df, 1, lags=2)
    single = forecast(sliding_windows(df, 8, 1).drop("value"), "rolling_mean", 8, 1)
    mine, other = error(joint), error(single)
    assert mine["b"] < 0.1 * other["b"] and mine["c"] < 0.1 * other["c"] and mine["a"] < 1.1 * other["a"]
    held = joint.where("split = 'test'").select(F.avg(((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("int"))).first()[0]
    assert 0.75 < held < 0.85
    far = joint_forecast(df, 3, lags=2).where("split = 'test' AND step = 3").select(F.avg(((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("int"))).first()[0]
    assert 0.75 < far < 0.85


def test_gaps_flat_features_and_short_series(spark):
    """A missing value takes its step out of fits and contexts; a flat feature is forecast as itself; too short a train split gives null points."""
    data = {f: list(v) for f, v in leading(120, 7).items()}
    data["flat"] = [4.0] * 120
    data["a"][30] = data["b"][90] = None
    rows = long(data, 60) + long({f: v[:12] for f, v in data.items()}, 6, "short")
    got = joint_forecast(spark.createDataFrame(rows, SCHEMA), 2, lags=2).collect()
    s = [r for r in got if r.series_id == "s"]
    assert all(abs(r.point - 4.0) < 1e-9 for r in s if r.feature == "flat")
    assert {r.origin for r in s if r.split == "test"} == set(range(2, 59)) - {31, 32}
    assert [r.y for r in s if r.split == "test" and r.feature == "b" and r.t == 30] == [None, None]
    assert all(r.point is None for r in got if r.series_id == "short")
    assert joint_forecast(spark.createDataFrame([], SCHEMA), 2).collect() == []


def test_the_calibrated_pipeline_takes_it(spark):
    """A spike in c that nothing leads to stands out."""
    data = leading(400, 9)
    data["c"][300] += 6
    df = spark.createDataFrame(long(data, 200), SCHEMA)
    labels = spark.range(200).selectExpr("'s' AS series_id", "'test' AS split", "id AS t", "CAST(id = 100 AS INT) AS y")
    got = pl.calibrated(df, labels, 4, 1, method="joint").collect()
    assert max(got, key=lambda r: r.max).t == 100
