"""The scoring pipelines, over all series at once; there is no loop over series.

Prepared points and evaluated scores are read several times by what follows, so they are written tables.

``points`` are long (series_id, split, t, feature, value), cleaned; ``labels`` are (series_id, split, t, y).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import errors
from tidewatch.functions.arrays import rounded_to
from tidewatch.operators import metrics, scoring
from tidewatch.operators.forecast import covariate_forecast, covariates_forecasts, forecast, mean_errors, points_of_summaries, summarised
from tidewatch.operators.joint import joint_forecast
from tidewatch.operators.prep import KEY, filled_fit
from tidewatch.operators.windows import BLOCK, sample_origins, sliding_windows
from tidewatch.sources.shared import cut, parallel

CALIBRATED = ["max", "topk", "l2", "mae"]
BAND = ["l2", "max", "mean", "topquarter"]


def prepared(points: DataFrame, scale: bool = True) -> DataFrame:
    """Features without train values dropped, gaps filled with the train median, optionally z-scored.

    Points are dealt over a set number of tasks, as windows sort them where they are: by their compressed size, Spark would give a task too many.
    """
    dealt, filled = points.repartition(parallel(points.sparkSession), *KEY), F.coalesce("value", "med")
    joined = dealt.join(filled_fit(points), KEY)
    return joined.withColumn("value", (filled - F.col("mu")) / F.col("sd") if scale else filled).drop("med", "mu", "sd")


def test_labels(labels: DataFrame) -> DataFrame:
    return labels.where("split = 'test'").select("series_id", "t", "y")


def window_forecasts(points: DataFrame, context: int, horizon: int, method: str = "rolling_mean", inner: bool = True, block: int = BLOCK, **options) -> DataFrame:
    """Forecasts and actuals of every window, train and test apart; with the method "joint" each feature's from all features (``operators.joint``)."""
    if method == "joint":
        return joint_forecast(points, horizon, context=context, inner=inner, block=block, **options)
    return forecast(sliding_windows(points, context, horizon, block=block, inner=inner).drop("value"), method, context, horizon, **options)


def window_errors(points: DataFrame, context: int, horizon: int, method: str = "rolling_mean", inner: bool = True, block: int = BLOCK, **options) -> DataFrame:
    """``scoring.window_errors`` of ``window_forecasts``; but for the method "joint", without a row a step."""
    if method == "joint":
        return scoring.window_errors(window_forecasts(points, context, horizon, method, inner, block, **options))
    w = sliding_windows(points, context, horizon, block=block, inner=inner).drop("value")
    return mean_errors(w, method, context, horizon, errors.in_deviations, **options).select("series_id", "split", "feature", "origin", "err")


def calibrated(points: DataFrame, labels: DataFrame, context: int, horizon: int, *, method: str = "rolling_mean", scale: bool = True, top_k: int = 3, **options) -> DataFrame:
    """Calibrated scoring: series_id, t, one score a combination, y. Origins are context <= t < n - horizon of the test split."""
    found = window_errors(cut(prepared(points, scale)), context, horizon, method, **options)
    scores = scoring.calibrate(cut(found)).withColumnRenamed("origin", "t")
    return scoring.combine(scores, CALIBRATED, top_k).join(test_labels(labels), ["series_id", "t"])


def method_metrics(scored: DataFrame, methods: list[str], strict: bool = True) -> DataFrame:
    """One row a series and method: auroc, auprc, best point, confusion counts, precision, recall, f1."""
    keys = ["series_id", "method"]
    long = cut(scored.unpivot(["series_id", "t", "y"], methods, "method", "score"))
    return metrics.summary_with_confusion(long, keys, strict)


def window_mse_scores(points: DataFrame, context: int, horizon: int, *, method: str = "rolling_mean", ready: DataFrame | None = None, **options) -> DataFrame:
    """Multivariate window error of every test step; steps without a window have 0. ``ready``: the points as ``prepared``, if at hand."""
    ready = cut(prepared(points)) if ready is None else ready
    return horizon_scores(ready, context, [horizon], method=method, **options).drop("horizon")


def horizon_scores(ready: DataFrame, context: int, horizons: list[int], *, method: str = "rolling_mean", **options) -> DataFrame:
    """``window_mse_scores`` for several horizons of one context, with the horizon as a column: windows are made and forecast once, for the longest."""
    test, longest = ready.where("split = 'test'"), max(horizons)
    slim = not options and summarised(method) is not None
    w = sliding_windows(test, context, longest, partial=True, arrays=not slim).drop("value")
    gaps = points_of_summaries(w, method, longest) if slim else forecast(w, method, context, longest, quantiles=False, **options)
    gaps = gaps.where("y is not null")
    e = (F.col("y") - F.col("point")) * (F.col("y") - F.col("point"))
    means = {h: F.when(F.max("step") >= h, F.avg(F.when(F.col("step") <= h, e))) for h in horizons}
    wide = gaps.groupBy("series_id", F.col("origin").alias("t")).agg(*(m.alias(f"h{h}") for h, m in means.items()))
    steps = test.select("series_id", "t").distinct()
    full = scoring.dense(steps, wide, [f"h{h}" for h in horizons])
    pairs = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("score")) for h in horizons))
    return full.select("series_id", "t", F.inline(pairs))


def evaluate(scores: DataFrame, labels: DataFrame, context: int, *, keys: tuple[str, ...] = ("series_id",), digits: int | None = None) -> DataFrame:
    """Saved or fresh scores against labels, from step ``context`` on: the summary by ``keys`` with confusion counts at the best threshold.

    With ``digits`` scores are rounded first, so that those that are equal but for the order of a sum tie.
    """
    kept = metrics.trim_after_context(scores, context)
    kept = kept if digits is None else kept.withColumn("score", rounded_to(F.col("score"), digits))
    return _evaluated(cut(kept.join(test_labels(labels), ["series_id", "t"])), list(keys))


def _evaluated(joined: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.summary_with_confusion(joined, keys)


def window_mse(points: DataFrame, labels: DataFrame, context: int, horizon: int, *, digits: int | None = None, **options) -> DataFrame:
    return evaluate(window_mse_scores(points, context, horizon, **options), labels, context, digits=digits)


def sweep(points: DataFrame, labels: DataFrame, configs: list[tuple[int, int]], *, digits: int | None = None, **options) -> DataFrame:
    """``window_mse`` for each (context, horizon), one summary row a series and configuration.

    Windows are made once a context, and all configurations are evaluated together.
    """
    ready = cut(prepared(points))
    parts = []
    for context in sorted({c for c, _ in configs}):
        found = horizon_scores(ready, context, sorted({h for c, h in configs if c == context}), **options)
        parts.append(metrics.trim_after_context(found, context).withColumn("context", F.lit(context)))
    scores = reduce(DataFrame.unionByName, parts)
    scores = scores if digits is None else scores.withColumn("score", rounded_to(F.col("score"), digits))
    return _evaluated(cut(scores.join(test_labels(labels), ["series_id", "t"])), ["series_id", "context", "horizon"])


def band_scores(points: DataFrame, context: int, horizon: int, *, score: str = errors.DEFAULT_SCORE, combination: str = "l2", smoothing: int = 5, method: str = "rolling_mean", **options) -> DataFrame:
    """Quantile-band scoring: blocks of ``horizon`` test steps are forecast from the last ``context`` steps before each, train and earlier test steps alike, or from as many as there are.

    ``points`` need their place in the whole series as ``at``. Scores are normalised by feature over
    the test split (which looks ahead), combined, and smoothed; a block with nothing before it scores 0.
    """
    points = cut(points)
    line = points.withColumns({"place": F.col("t"), "t": F.col("at")})
    w = sliding_windows(line, context, keys=["series_id", "feature"], least=1).where((F.col("split") == "test") & (F.col("place") % horizon == 0))
    f = forecast(w.drop("value"), method, context, horizon, **options)
    test = points.where("split = 'test'")
    actual = test.select("series_id", "feature", F.col("at").alias("t"), F.col("t").alias("place"), F.col("value").alias("y"))
    gaps = f.drop("place").join(actual, ["series_id", "feature", "t"])
    s = gaps.select("series_id", "feature", F.col("place").alias("t"), errors.score(score, F.col("y"), F.col("q50"), F.col("q10"), F.col("q90")).alias("score"))
    combined = scoring.combine(scoring.robust_normalize(s), [combination]).withColumnRenamed(combination, "score")
    return scoring.smooth(scoring.dense(test.select("series_id", "t").distinct(), combined, ["score"]), "score", smoothing)


def band(points: DataFrame, labels: DataFrame, context: int, horizon: int, *, digits: int | None = None, **options) -> DataFrame:
    """auroc and auprc by series; ``digits`` as in ``evaluate``."""
    return _areas(band_scores(points, context, horizon, **options), labels, digits)


def _areas(scores: DataFrame, labels: DataFrame, digits: int | None) -> DataFrame:
    scores = scores if digits is None else scores.withColumn("score", rounded_to(F.col("score"), digits))
    return metrics.areas(cut(scores.join(test_labels(labels), ["series_id", "t"])), ["series_id"])


def covariate_scores(points: DataFrame, horizon: int, pairs: dict[str, str] | list[str]) -> DataFrame:
    """Each target from its covariate (dict), or from all other features (list): squared errors, scaled by feature, joined by their L2 norm."""
    points = cut(points)
    if isinstance(pairs, dict):
        f = reduce(DataFrame.unionByName, [covariate_forecast(points, t, c, horizon) for t, c in pairs.items()])
    else:
        f = covariates_forecasts(points, pairs, horizon)
    # written, as scores are read for their range and once more
    s = cut(f.where("y is not null and point is not null").select("series_id", "feature", "t", errors.squared(F.col("y"), F.col("point")).alias("score")))
    return scoring.combine(scoring.minmax_scores(s), ["l2"]).withColumnRenamed("l2", "score")


def covariate(points: DataFrame, labels: DataFrame, horizon: int, pairs: dict[str, str] | list[str], *, digits: int | None = None) -> DataFrame:
    return _areas(covariate_scores(points, horizon, pairs), labels, digits)


def window_records(points: DataFrame, labels: DataFrame, context: int, horizon: int, every: int = 5, top_k: int = 3) -> DataFrame:
    """Every n-th test origin for inspection: values, forecasts, actuals and calibrated scores of all features in name order, combined scores, label."""
    ready = cut(prepared(points))
    w = sliding_windows(ready, context, horizon, inner=True).drop("value")
    gaps = forecast(w, "rolling_mean", context, horizon)
    scores = scoring.calibrate(scoring.window_errors(gaps))
    steps = gaps.where("split = 'test'").groupBy("series_id", "feature", "origin").agg(F.sort_array(F.collect_list(F.struct("step", "point"))).alias("f"))
    kept = sample_origins(w.where("split = 'test'"), context, every).withColumnRenamed("t", "origin")
    one = kept.join(steps, ["series_id", "feature", "origin"]).join(scores.drop("split"), ["series_id", "feature", "origin"])
    row = F.struct("feature", "ctx", F.transform("f", lambda s: s["point"]).alias("forecast"), "fut", "score")
    rec = one.groupBy("series_id", "origin").agg(F.sort_array(F.collect_list(row)).alias("r"))
    combined = scoring.combine(scores.withColumnRenamed("origin", "t"), ["max", "topk", "l2"], top_k)
    part = lambda name: F.transform("r", lambda x: x[name])
    out = rec.withColumnRenamed("origin", "t").select(
        "series_id", "t", part("ctx").alias("context_values"), part("forecast").alias("forecast_values"), part("fut").alias("actual_values"), part("score").alias("feature_scores")
    )
    named = combined.select("series_id", "t", F.col("max").alias("score_max"), F.col("topk").alias("score_topk"), F.col("l2").alias("score_l2"))
    return out.join(named, ["series_id", "t"]).join(test_labels(labels).withColumnRenamed("y", "is_anomaly"), ["series_id", "t"], "left")
