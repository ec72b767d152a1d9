"""Errors of windows without a row a step against those of rows, for every method and option; confusion counts from the running counts against those of the alarms."""

import math
import random

import pytest

from tidewatch.functions import errors
from tidewatch.operators import metrics, scoring
from tidewatch.operators.forecast import METHODS, forecast, mean_errors
from tidewatch.operators.windows import sliding_windows

POINTS = "series_id string, split string, feature string, t long, value double"


@pytest.fixture(scope="module")
def windows(spark):
    rng = random.Random(4)
    rows = [(s, "test", f, t, float(rng.choice([0, 1, 5, 2.5, -3 if s == "b" else 7]))) for s in "ab" for f in "xy" for t in range(40)]
    return sliding_windows(spark.createDataFrame(rows, POINTS), 8, 3, least=2, partial=True).drop("value").cache()


@pytest.mark.parametrize("method", sorted(METHODS))
def test_errors_equal_those_of_rows(windows, method):
    for options in ({}, {"flip": True, "normalize": True, "non_negative": True}):
        want = {(r.series_id, r.feature, r.origin): r.err for r in scoring.window_errors(forecast(windows, method, 8, 3, **options)).collect()}
        found = mean_errors(windows, method, 8, 3, errors.in_deviations, **options)
        got = {(r.series_id, r.feature, r.origin): r.err for r in found.collect()}
        assert got.keys() == want.keys() and len(got) == 4 * 38
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_steps_do_not_become_rows(windows):
    """Neither a generator nor an aggregate but those of the windows."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = plan(mean_errors(windows, "rolling_mean", 8, 3, errors.in_deviations))
    assert made.count("Generate explode") == plan(windows).count("Generate explode") and "Aggregate [" not in made


@pytest.mark.parametrize("strict", [True, False])
def test_confusion_comes_from_running_counts(spark, strict):
    rng = random.Random(7)
    rows = [(k, float(rng.randrange(6)) if rng.random() < 0.95 else None, rng.randrange(2) if k not in "pn" else int(k == "p")) for k in "abpnz" for _ in range(30 if k != "z" else 1)]
    rows += [("worst", float(10 - i), int(i > 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, score double, y int")
    best = metrics.summary(df, ["k"])
    want = best.join(metrics.confusion(metrics.alarms(df, best, ["k"], strict), ["k"]), ["k"])
    got = metrics.summary_with_confusion(df, ["k"], strict)
    assert got.columns == want.columns and {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2
