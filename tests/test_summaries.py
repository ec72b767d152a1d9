"""Forecasts from a context's count, mean and ends equal those from its values."""

import pytest

from tidewatch.operators.forecast import forecast, points_of_summaries, summarised
from tidewatch.operators.windows import sliding_windows


@pytest.mark.parametrize("method", ["naive_last", "rolling_mean", "drift"])
@pytest.mark.parametrize("least", [None, 1])
def test_points_equal_those_of_arrays(spark, method, least):
    rows = [("a", "test", f, t, None if (t * 7 + k) % 11 == 0 else (t * 37 % 17) / 3 - k * 1e6) for k, f in enumerate("xy") for t in range(60)]
    points = spark.createDataFrame([*rows, ("b", "test", "x", 0, 1.0)], "series_id string, split string, feature string, t long, value double")
    made = lambda arrays: sliding_windows(points, 8, 3, partial=True, least=least or 6, block=16, arrays=arrays).drop("value")
    plain, slim = forecast(made(True), method, 8, 3, quantiles=False), points_of_summaries(made(False), method, 3)
    columns = sorted(plain.columns)
    assert columns == sorted(slim.columns)
    found = [sorted(map(repr, map(tuple, x.select(columns).collect()))) for x in (plain, slim)]
    assert found[0] == found[1] and len(found[0]) > 100


def test_methods_of_values_are_refused(spark):
    windows = spark.createDataFrame([(1, 2, 1.0, 1.0, 1.0)], "t long, ctx_n long, ctx_mean double, ctx_first double, ctx_last double")
    assert summarised("rolling_median") is None
    with pytest.raises(ValueError, match="needs the values"):
        points_of_summaries(windows, "rolling_median", 2)
