"""Preparation, windows, forecasts, scores, pipelines, files and the online scorer on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import errors
from tidewatch.operators import prep, profile, scoring, windows
from tidewatch.operators.forecast import apply_model, covariate_forecast, covariates_forecast, forecast
from tidewatch.plans import pipelines as pl
from tidewatch.sources import series, sinks
from tidewatch.streaming.online import online_scores

POINT = "series_id string, split string, t long, feature string, value double"


def make(spark, values, series_id="s"):
    """values: {feature: {split: list}}"""
    rows = [(series_id, split, t, f, v) for f, by in values.items() for split, xs in by.items() for t, v in enumerate(xs)]
    return spark.createDataFrame(rows, POINT).repartition(3)


def ramp(n, k=1.0):
    return [float((i * 7 % 13) * k + i * 0.1) for i in range(n)]


def test_cleaning_and_fits(spark):
    df = make(spark, {"a": {"train": [1.0, -1.0, float("nan"), 4.0], "test": [None, 10.0]}, "flat": {"train": [2.0, 2.0], "test": [3.0]}, "none": {"train": [-1.0, None], "test": [5.0]}})
    c = prep.clean_missing(df)
    assert c.where("value is null").count() == 5
    assert {r.feature for r in prep.drop_empty_features(c).select("feature").distinct().collect()} == {"a", "flat"}
    assert {r.feature for r in prep.drop_flat_features(c).select("feature").distinct().collect()} == {"a"}
    filled = prep.impute(c)
    assert sorted(r.value for r in filled.where("feature = 'a'").collect()) == [1.0, 2.5, 2.5, 2.5, 4.0, 10.0]
    z = {(r.split, r.t): r.value for r in prep.zscore(filled).where("feature = 'a'").collect()}
    sd = np.std([1, 2.5, 2.5, 4])
    assert math.isclose(z["test", 1], 7.5 / sd)
    assert {r.value for r in prep.zscore(filled).where("feature = 'flat' and split = 'train'").collect()} == {0.0}
    assert {r.value for r in prep.minmax(filled).where("feature = 'flat' and split = 'test'").collect()} == {1.0}
    assert {r.feature for r in profile.removed_features(c, prep.drop_empty_features(c)).collect()} == {"none"}


def test_features_and_labels(spark):
    wide = spark.createDataFrame([("s", 0, 1.0, 2.0, 1)], "series_id string, t long, `4_jvm-x` double, b double, is_anomaly int")
    long, lab = prep.features_and_labels(wide, ["series_id", "t"])
    assert sorted((r.feature, r.value) for r in long.collect()) == [("4_jvm-x", 1.0), ("b", 2.0)] and lab.first().is_anomaly == 1
    _, lab = prep.features_and_labels(wide.drop("is_anomaly"), ["series_id", "t"])
    assert lab.first().is_anomaly is None
    with pytest.raises(ValueError):
        prep.features_and_labels(wide.drop("is_anomaly"), ["series_id", "t"], require=True)


@pytest.mark.parametrize("n,c,h", [(20, 4, 3), (7, 4, 3), (6, 4, 3), (5, 5, 0), (50, 8, 1)])
def test_window_counts_and_halo(spark, n, c, h):
    df = make(spark, {"a": {"test": ramp(n)}})
    wide = windows.sliding_windows(df, c, h)
    assert wide.count() == max(0, n - c - h + (1 if h else 0))
    tight = windows.sliding_windows(df, c, h, block=8)
    key = lambda d: sorted((r.t, r.ctx, r.fut if h else None) for r in d.collect())
    assert key(wide) == key(tight)
    for r in wide.collect():
        assert r.ctx == ramp(n)[r.t - c : r.t]
    if h:
        assert windows.sliding_windows(df, c, h, inner=True).count() == max(0, n - c - h)
    with pytest.raises(ValueError):
        windows.sliding_windows(df, 9, 1, block=8)


def test_blocks_and_grid(spark):
    b = windows.block_origins(make(spark, {"a": {"test": ramp(10)}}), 4)
    assert sorted((r.t, r.window_id, r.origin, r.step) for r in b.collect())[-2:] == [(8, 2, 8, 1), (9, 2, 8, 2)]
    ts = spark.sql("select 'x' k, timestamp_seconds(id * 60) ts from range(5) union all select 'y', timestamp_seconds(id * id) from range(5)")
    got = {r.k: (r.n, r.n_steps, r.regular) for r in windows.grid_check(ts, ["k"], "ts").collect()}
    assert got == {"x": (5, 1, True), "y": (5, 4, False)}


def test_forecast_methods(spark):
    w = windows.sliding_windows(make(spark, {"a": {"test": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]}}), 4, 2).where("t = 4")
    point = lambda m, **o: [r.point for r in sorted(forecast(w, m, 4, 2, **o).collect(), key=lambda r: r.step)]
    assert point("naive_last") == [1.0, 1.0]
    assert point("seasonal_naive", season=3) == [1.0, 4.0]
    assert point("rolling_mean") == [2.25, 2.25] and point("rolling_median") == [2.0, 2.0]
    assert np.allclose(point("drift"), [1 - 2 / 3, 1 - 4 / 3])
    assert np.allclose(point("drift", non_negative=True), [1 / 3, 0.0])
    level = 3.0
    for x in (1.0, 4.0, 1.0):
        level = 0.3 * x + 0.7 * level
    assert np.allclose(point("ses", alpha=0.3), [level] * 2)
    assert np.allclose(point("rolling_mean", normalize=True, flip=True), [2.25] * 2)
    r = forecast(w, "rolling_mean", 4, 1).first()
    assert np.allclose([r.q10, r.q50, r.q90], np.quantile([3, 1, 4, 1], [0.1, 0.5, 0.9])) and r.y == 5.0
    with pytest.raises(ValueError):
        forecast(w, "nothing", 4, 1)


def test_model_callable(spark):
    w = windows.sliding_windows(make(spark, {"a": {"test": ramp(12)}}), 4, 2)

    def load():
        return lambda x: np.stack([np.repeat(np.quantile(x, q, axis=1, keepdims=True), 2, axis=1) for q in (0.1, 0.5, 0.9)], axis=2)

    got = {(r.t, r.step): (r.point, r.q10, r.q90) for r in apply_model(w, load, 2).collect()}
    for r in forecast(w, "rolling_median", 4, 2).collect():
        assert np.allclose(got[r.t, r.step], (r.point, r.q10, r.q90))


def test_covariates(spark):
    x = ramp(40)
    df = make(spark, {"y": {"train": [2 * v + 1 for v in x[:20]], "test": [2 * v + 1 for v in x[20:]]}, "x": {"train": x[:20], "test": x[20:]}})
    for f in (covariate_forecast(df, "y", "x", 6), covariates_forecast(df, "y", 6)):
        rows = f.collect()
        assert len(rows) == 20 and all(math.isclose(r.y, r.point, abs_tol=1e-6) for r in rows)


def test_score_functions(spark):
    row = spark.createDataFrame([(5.0, 3.0, 1.0, 4.0), (2.0, 3.0, 1.0, 4.0)], "y double, p double, lo double, hi double")
    c = [F.col(x) for x in ("y", "p", "lo", "hi")]
    got = row.select(*(errors.score(m, *c).alias(m) for m in errors.SCORES)).collect()
    assert (got[0].mse, got[0].interval, got[1].interval) == (4.0, 1.0, 0.0)
    assert math.isclose(got[0].normalized_deviation, 2 / (3 + 1e-8)) and math.isclose(got[0].smape, 4 / (8 + 1e-8))
    u = spark.createDataFrame([(0.0, 2.56), (1.0, 1.0), (None, None)], "lo double, hi double").select(errors.uncertainty(F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in u] == [1.0, 1e-3, 1.0]
    with pytest.raises(ValueError):
        errors.score("other", *c)


def test_combination_and_normalisation(spark):
    s = spark.createDataFrame([("s", f, 0, float(v)) for f, v in zip("abcdefgh", [1, 2, 3, 4, 5, 6, 7, -8])] + [("u", "a", 0, 2.0)], "series_id string, feature string, t long, score double")
    got = {r.series_id: r for r in scoring.combine(s, list(scoring.AGGREGATIONS)).collect()}
    assert (got["s"]["max"], got["s"]["topk"], got["s"]["topquarter"], got["s"]["mae"]) == (7.0, 6.0, 6.5, 4.5)
    assert (got["u"]["topk"], got["u"]["topquarter"], got["u"]["l2"], got["u"]["mse"]) == (2.0, 2.0, 2.0, 4.0)
    with pytest.raises(ValueError):
        scoring.combine(s, ["most"])
    v = spark.createDataFrame([("s", "a", t, float(t)) for t in range(101)] + [("s", "c", t, 1.0) for t in range(3)] + [("s", "a", 200, None)], "series_id string, feature string, t long, score double")
    n = {(r.feature, r.t): r.score for r in scoring.robust_normalize(v).collect()}
    assert n["a", 0] == 0.0 and n["a", 100] == 1.0 and math.isclose(n["a", 50], 0.5) and n["c", 1] == 0.0 and n["a", 200] == 0.0
    m = {(r.feature, r.t): r.score for r in scoring.minmax_scores(v.where("t < 200")).collect()}
    assert m["a", 25] == 0.25 and m["c", 0] == 0.0
    cal = spark.createDataFrame([("s", "train", "a", 1, 1.0), ("s", "train", "a", 2, 3.0), ("s", "test", "a", 1, 5.0), ("s", "test", "b", 1, 2.0)], "series_id string, split string, feature string, origin long, err double")
    got = {r.feature: r.score for r in scoring.calibrate(cal).collect()}
    assert math.isclose(got["a"], 3 / (1 + 1e-8)) and got["b"] == 2.0


def labelled(spark, n_train=60, n_test=80):
    x, y = ramp(n_train + n_test), ramp(n_train + n_test, 2.0)
    for i in range(n_train + 50, n_train + 55):
        x[i] += 60
    df = make(spark, {"a": {"train": x[:n_train], "test": x[n_train:]}, "b": {"train": y[:n_train], "test": y[n_train:]}})
    lab = spark.createDataFrame([("s", "test", t, int(50 <= t < 55)) for t in range(n_test)], "series_id string, split string, t long, y int")
    return df, lab


def test_pipelines_find_the_bump(spark):
    df, lab = labelled(spark)
    out = pl.window_mse(df, lab, 8, 1).first()
    assert out.auroc > 0.95 and out.tp == 5
    c = pl.calibrated(df, lab, 8, 2)
    assert c.count() == 80 - 8 - 2
    m = {r.method: r for r in pl.method_metrics(c, pl.CALIBRATED).collect()}
    assert set(m) == set(pl.CALIBRATED) and m["max"].auroc > 0.9
    assert pl.sweep(df, lab, [(8, 1), (8, 2)]).count() == 2
    line = df.withColumn("at", F.when(F.col("split") == "test", F.col("t") + 60).otherwise(F.col("t")))
    assert pl.band(line, lab, 8, 3).first().auroc > 0.8
    assert pl.band_scores(line, 8, 3).count() == 80  # the last block has two steps
    assert pl.covariate(df, lab, 10, {"a": "b"}).first().auroc > 0.9
    rec = pl.window_records(df, lab, 8, 2)
    r = rec.where("t = 8").first()
    assert len(r.context_values) == 2 and len(r.context_values[0]) == 8 and len(r.actual_values[1]) == 2
    assert {x.t % 5 for x in rec.collect()} == {3}


def test_short_series_scores_zero(spark):
    df = make(spark, {"a": {"train": ramp(5), "test": ramp(6)}})
    assert [r.score for r in pl.window_mse_scores(df, 5, 3).collect()] == [0.0] * 6


def test_results_do_not_depend_on_row_order(spark):
    df, lab = labelled(spark)
    a = pl.window_mse(df, lab, 8, 2).first()
    b = pl.window_mse(df.orderBy(F.rand(3)).repartition(7), lab, 8, 2).first()
    assert all(x == y or math.isclose(x, y, rel_tol=1e-9) for x, y in list(zip(a, b))[1:])


def test_csv_series(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "m_1_train.csv").write_text("timestamp,a,is_anomaly\n3,1.0,0\n1,2.0,0\n2,,0\n")
    (d / "m_1_test.csv").write_text("timestamp,a,is_anomaly\n1,5,1\n")
    (d / "combined_train.csv").write_text("timestamp,a,is_anomaly\n1,9,1\n")
    schema = "timestamp long, a double, is_anomaly int"
    got = series.read_csv_series(spark, str(d), schema, exclude=("combined",))
    assert sorted((r.series_id, r.split, r.t, r.a) for r in got.collect() if r.a is not None) == [("m_1", "test", 0, 5.0), ("m_1", "train", 0, 2.0), ("m_1", "train", 2, 1.0)]
    assert series.csv_points(spark, str(d), schema, glob="*_train.csv").count() == 4
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "x.csv").write_text("a\n" + "\n".join(str(i) for i in range(50)))
    rows = series.read_csv_series(spark, str(bare), "a double").collect()
    assert all(r.t == r.a and r.split == "test" for r in rows)


def test_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    sinks.create_results(spark, p("r"))
    one = spark.createDataFrame([("f", 0.5, 0.25)], sinks.RESULTS)
    sinks.append_results(one, p("r"))
    sinks.create_results(spark, p("r"))
    sinks.append_results(one, p("r"))
    assert spark.read.parquet(p("r")).count() == 2
    s = spark.createDataFrame([("d", 8, 1, "mse", "s", 0, 1.0), ("d", 9, 1, "mse", "s", 0, 2.0)], "dataset string, context int, horizon int, method string, series_id string, t long, score double")
    sinks.write_scores(s, p("s"))
    assert series.read_scores(spark, p("s")).where("context = 9").first().score == 2.0
    sinks.write_curve(spark.createDataFrame([("s", 0.0, 0.0, float("inf"))], "series_id string, fpr double, tpr double, threshold double"), p("c"))
    assert spark.read.parquet(p("c")).first().threshold == float("inf")
    sinks.write_method_metrics(spark.createDataFrame([("max", 0.9)], "method string, auroc double"), p("m"), "smd")
    assert spark.read.parquet(p("m")).first().dataset == "smd"
    sinks.write_summary(one, p("csv"))
    sinks.write_report(one, p("json"))
    assert spark.read.json(p("json")).first().AUROC == 0.5
    sinks.write_window_records(spark.createDataFrame([([[1.0]],)], "context_values array<array<double>>"), p("w"))
    df, lab = labelled(spark)
    scores = pl.window_mse_scores(df, 8, 1)
    sinks.write_scores(scores.selectExpr("'d' dataset", "8 context", "1 horizon", "'mse' method", "*"), p("saved"))
    again = pl.evaluate(series.read_scores(spark, p("saved")).where("context = 8"), lab, 8).first()
    assert math.isclose(again.auroc, pl.evaluate(scores, lab, 8).first().auroc)


def test_stream_equals_batch(spark, tmp_path):
    df, _ = labelled(spark)
    c = 8
    g = pl.window_forecasts(df, c, 1, inner=False)
    errs = scoring.window_errors(g)
    cal = errs.where("split = 'train'").groupBy("series_id", "feature").agg(F.avg("err").alias("mu"), (F.stddev_pop("err") + 1e-8).alias("sd"))
    want = {(r.feature, r.origin): r.score for r in scoring.calibrate(errs).collect()}
    test = df.where("split = 'test'").select("series_id", "feature", "t", F.col("value").alias("y"))
    for lo, hi in ((0, 30), (30, 80)):
        test.where(f"t >= {lo} and t < {hi}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "in"))
    q = online_scores(stream, cal, c).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    got = {(r.feature, r.t): r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in want)


def test_profiles(spark):
    df = make(spark, {"a": {"train": [0.0, 1.0, 2.0, 30.0], "test": [5.0, 5.0]}})
    d = profile.drift(df).first()
    assert (d.drift, d.test_std) == (3.25, 0.0)
    h = {(r.split, r.bin): r.n for r in profile.histogram(df).collect()}
    assert h == {("train", 1): 1, ("train", 2): 1, ("train", 3): 1, ("train", 30): 1, ("test", 1): 2}
    both = df.unionByName(make(spark, {"a": {"train": [1.0]}, "b": {"train": [1.0]}}, "u"))
    assert {r.feature: (r.n_series, r.common) for r in profile.feature_sets(both).collect()} == {"a": (2, True), "b": (1, False)}
    p = profile.collection(both).first()
    assert (p.n_series, p.shortest, p.longest, p.most_features) == (2, 1, 4, 2)
