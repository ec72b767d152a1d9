"""Missing rows, short beginnings, late arrivals, one-class summaries."""

import datetime
import math

import numpy as np
import pytest
from test_series import make, ramp

from tidewatch.operators import metrics
from tidewatch.operators.forecast import METHODS, covariates_forecast, forecast
from tidewatch.operators.windows import sliding_windows
from tidewatch.plans import pipelines as pl
from tidewatch.streaming.online import online_scores


def test_covariates_keep_their_places_when_a_row_is_missing(spark):
    """y = 2 a - 3 b + c + 1 for three covariates; some of their rows, and some of y's, are absent."""
    rng = np.random.default_rng(4)
    n, cut = 60, 30
    x = {k: rng.normal(size=n).round(3).tolist() for k in "abc"}
    x["y"] = [2 * a - 3 * b + c + 1 for a, b, c in zip(x["a"], x["b"], x["c"])]
    rows = [("s", "train" if i < cut else "test", i if i < cut else i - cut, f, v[i]) for f, v in x.items() for i in range(n)]
    lost = {("test", 4, "a"), ("test", 5, "b"), ("train", 7, "c"), ("test", 11, "y")}
    rows = [r for r in rows if r[1:4] not in lost]
    got = covariates_forecast(spark.createDataFrame(rows, "series_id string, split string, t long, feature string, value double"), "y", 6).collect()
    assert sorted(r.t for r in got) == list(range(30))
    for r in got:
        assert r.point is None if r.t in (4, 5) else math.isclose(r.point, x["y"][cut + r.t], abs_tol=1e-6)


@pytest.mark.parametrize("method", sorted(METHODS))
def test_band_scores_blocks_with_a_short_past(spark, method):
    values = [float((i * 7) % 5) for i in range(30)]
    df = make(spark, {"a": {"train": values[:3], "test": values[3:]}})
    points = df.selectExpr("*", "CASE WHEN split = 'train' THEN t ELSE t + 3 END AS at")
    got = sorted((r.t, r.score) for r in pl.band_scores(points, 8, 4, smoothing=1, method=method, score="mse").collect())
    assert [t for t, _ in got] == list(range(27)) and all(0 <= s <= 1 for _, s in got)
    assert any(s > 0 for t, s in got if t < 4)
    alone = points.where("split = 'test'")
    none = sorted((r.t, r.score) for r in pl.band_scores(alone.withColumn("at", alone["t"]), 8, 4, smoothing=1, method=method).collect())
    assert [t for t, _ in none] == list(range(27)) and all(s == 0 for t, s in none if t < 4)


def test_short_contexts_end_where_the_series_begins(spark):
    w = sliding_windows(make(spark, {"a": {"test": ramp(6)}}), 4, 3, least=1, partial=True)
    got = {r.t: (len(r.ctx), len(r.fut)) for r in w.collect()}
    assert got == {1: (1, 3), 2: (2, 3), 3: (3, 3), 4: (4, 2), 5: (4, 1)}
    assert all(r.point is not None for m in METHODS for r in forecast(w, m, 4, 3).collect())


def test_a_sweep_equals_its_configurations(spark):
    rng = np.random.default_rng(1)
    df = make(spark, {"a": {"train": rng.normal(size=30).tolist(), "test": rng.normal(size=60).tolist()}})
    labels = spark.range(60).selectExpr("'s' AS series_id", "'test' AS split", "id AS t", "CAST(id % 9 = 0 AS INT) AS y")
    configs = [(8, 1), (8, 4), (5, 4)]
    found = {(r.context, r.horizon): r.asDict() for r in pl.sweep(df, labels, configs).collect()}
    for c, h in configs:
        (one,) = pl.window_mse(df, labels, c, h).collect()
        assert all(found[c, h][k] == v for k, v in one.asDict().items())


def test_summary_equals_the_curve(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(round(rng.normal(), 1)), int(rng.random() < p)) for k, p in (("mixed", 0.3), ("few", 0.05), ("none", 0.0), ("all", 1.0)) for _ in range(60)]
    rows += [("inverted", float(i), int(i < 5)) for i in range(10)]
    scored = spark.createDataFrame(rows, "k string, score double, y int")
    whole = {r.k: r.asDict() for r in metrics.summary(scored, ["k"]).collect()}
    for part in (metrics.areas(scored, ["k"]), metrics.youden(metrics.roc_curve(scored, ["k"]), ["k"])):
        for r in part.collect():
            assert all(whole[r.k][name] == v for name, v in r.asDict().items())
    assert len(whole) == 5 and whole["inverted"]["best_threshold"] == math.inf


def test_late_arrivals_are_dropped(spark, tmp_path):
    """The third file holds arrivals before and behind the watermark that the first two have set."""
    start = datetime.datetime(2024, 1, 1)
    hours = [list(range(0, 6)), list(range(6, 12)), [2, 11.5, 12, 13]]
    schema = "series_id string, feature string, t long, y double, ts timestamp"
    path = str(tmp_path / "in")
    for part in hours:
        rows = [("s", "f", int(h * 2), float((h * 3) % 7), start + datetime.timedelta(hours=h)) for h in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    none = spark.range(0).selectExpr("'' AS series_id", "'' AS feature", "0D AS mu", "1D AS sd")
    seen = {}
    for delay in (None, "2 hours"):
        out = str(tmp_path / f"out{delay}")
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        run = online_scores(arrivals, none, 4, delay=delay).writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
        run.awaitTermination()
        seen[delay] = sorted(r.t for r in spark.read.parquet(out).collect())
    assert seen[None] == sorted([*range(8, 24, 2), 4, 23, 24, 26])
    # up to two hours before the last arrival, which is as far as the watermark has come
    assert seen["2 hours"] == [*range(8, 24, 2)]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tidewatch.sources.shared import shared_path

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_path(away)
