"""The registered queries and their SQL twins, over the driver's tables as series."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import errors
from tidewatch.functions.arrays import rounded_to, total
from tidewatch.operators import metrics, prep, profile, scoring, stored, windows
from tidewatch.operators.forecast import apply_model, covariate_forecast, covariates_forecast, forecast
from tidewatch.operators.joint import joint_forecast
from tidewatch.operators.tensors import apply_joint_model
from tidewatch.plans import pipelines as pl
from tidewatch.plans.oracles import ALPHA, C, H, LAGS, PREAMBLE, SEASON, _metrics, covariates_ctes, sweep_part
from tidewatch.functions import naming
from tidewatch.sources import commits, series, sinks
from tidewatch.sources.shared import cut, shared_path
from tidewatch.streaming.online import online_scores

FLAGSHIP = "pipeline_calibrated"
#: Scores are rounded to so many digits before they are ranked, here and in the twins.
DIGITS = 5
SWEEP = [(24, 1), (24, 4), (48, 4)]
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the final SELECT of its twin, or with a comma and further CTEs before it."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = f"{PREAMBLE}{sql}" if sql.startswith(",") else f"{PREAMBLE} {sql}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded as the twins do it, with negative zero as zero."""
    return df.withColumns({c: rounded_to(F.col(c), digits) + F.lit(0.0) for c in columns})


def r(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``rounded``."""
    return f"round({expr}, {digits}) + 0.0"


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.event_points(table(spark, sf_dir, "events"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned event series, split at 20 %, with the place in the whole series as ``at``."""
    raw = series.event_points(table(spark, sf_dir, "events"), length="n")
    return prep.split_by_position(prep.clean_missing(raw).withColumn("at", F.col("t")), length="n")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_by_position(series.event_labels(table(spark, sf_dir, "events"), length="n"), length="n")


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.prepared(points(spark, sf_dir), scale=False)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.prepared(points(spark, sf_dir))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_by_position(series.line_points(table(spark, sf_dir, "lineitem")))


def scaled_windows(spark: SparkSession, sf_dir: str, horizon: int = H) -> DataFrame:
    return windows.sliding_windows(scaled(spark, sf_dir).drop("at"), C, horizon).drop("value")


def gaps(spark: SparkSession, sf_dir: str, inner: bool = True) -> DataFrame:
    return pl.window_forecasts(scaled(spark, sf_dir).drop("at"), C, H, inner=inner)


def scaled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.window_errors(scaled(spark, sf_dir).drop("at"), C, H)


def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.calibrate(scaled_errors(spark, sf_dir)).withColumnRenamed("origin", "t")


# --- sources, cleaning, splitting, scaling


@query("SELECT series_id, feature, count(*) AS n, count(CASE WHEN value IS NULL OR value = -1 THEN 1 END) AS n_missing FROM raw_ GROUP BY ALL")
def prep_sentinel_null(spark, sf_dir):
    return prep.clean_missing(raw_points(spark, sf_dir)).groupBy("series_id", "feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"))


@query(f"SELECT series_id, split, t, feature, {r('value')} AS value FROM z")
def prep_impute_zscore(spark, sf_dir):
    return rounded(scaled(spark, sf_dir).select("series_id", "split", "t", "feature", "value"), "value")


@query("""SELECT series_id, feature FROM pts WHERE NOT (series_id = 's1' AND feature = 'click' AND split = 'train') GROUP BY ALL
HAVING count(CASE WHEN split = 'train' THEN value END) > 0""")
def prep_drop_empty_features(spark, sf_dir):
    lost = (F.col("series_id") == "s1") & (F.col("feature") == "click") & (F.col("split") == "train")
    p = points(spark, sf_dir).withColumn("value", F.when(~lost, F.col("value")))
    return prep.drop_empty_features(p).select("series_id", "feature").distinct()


@query("SELECT series_id, feature FROM pts GROUP BY ALL HAVING count(DISTINCT CASE WHEN split = 'train' THEN CASE WHEN feature = 'view' THEN 5.0 + 0 * value ELSE value END END) > 1")
def prep_drop_flat_features(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("value", F.when((F.col("feature") == "view") & F.col("value").isNotNull(), F.lit(5.0)).otherwise(F.col("value")))
    return prep.drop_flat_features(p).select("series_id", "feature").distinct()


@query("SELECT series_id, split, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM pts GROUP BY ALL")
def split_by_position(spark, sf_dir):
    return points(spark, sf_dir).groupBy("series_id", "split").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


@query(f"""SELECT series_id, split, t, feature, {r('(value - lo) / coalesce(nullif(hi - lo, 0), 1)', 4)} AS value
FROM lp JOIN (SELECT series_id, feature, min(value) AS lo, max(value) AS hi FROM lp WHERE split = 'train' GROUP BY ALL) USING (series_id, feature)""")
def minmax_train_only(spark, sf_dir):
    return rounded(prep.minmax(line_points(spark, sf_dir)), "value", digits=4).select("series_id", "split", "t", "feature", "value")


@query(f"SELECT series_id, feature, {r('med')} AS med FROM med")
def train_medians(spark, sf_dir):
    return rounded(prep.medians(points(spark, sf_dir)).where("med is not null"), "med")


@query(f"""SELECT series_id, feature, count(*) AS n, {r('avg(value)', 4)} AS mu, {r('coalesce(nullif(stddev_pop(value), 0), 1)', 4)} AS sd, {r('min(value)')} AS lo, {r('max(value)')} AS hi,
{r('quantile_disc(value, 0.5)')} AS med, {r('quantile_disc(value, 0.99)')} AS p99 FROM pts WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL""")
def stored_statistics(spark, sf_dir):
    """Statistics of three parts of the steps, stored one by one (one of them twice), merged when read. Series have fewer steps than a sketch holds, so quantiles are exact."""
    path, p = shared_path(spark), points(spark, sf_dir)
    for part in (0, 1, 2, 1):
        stored.store_statistics(stored.fit_statistics(p.where(F.col("t") % 3 == part)), path, f"part{part}")
    stats = stored.stored_statistics(spark, path)
    out = stored.fits(stats).join(stats.select("series_id", "feature", "n"), ["series_id", "feature"]).select("series_id", "feature", "n", "mu", "sd", "lo", "hi", "med", "p99")
    return rounded(rounded(out, "mu", "sd", digits=4), "lo", "hi", "med", "p99")


@query(f"""SELECT series_id, feature, split, count(*) AS n, {r('sum((coalesce(value, med) - mu) / sd)', 3)} AS total, {r('max((coalesce(value, med) - mu) / sd)', 4)} AS top FROM pts
JOIN (SELECT series_id, feature, quantile_disc(value, 0.5) AS med, avg(value) AS mu, coalesce(nullif(stddev_pop(value), 0), 1) AS sd FROM pts WHERE split = 'train' AND value IS NOT NULL GROUP BY ALL) USING (series_id, feature) GROUP BY ALL""")
def scaled_by_stored(spark, sf_dir):
    """Gaps filled and values scaled by stored statistics of two halves."""
    path, p = shared_path(spark), points(spark, sf_dir)
    for part in (0, 1):
        stored.store_statistics(stored.fit_statistics(p.where(F.col("t") % 2 == part)), path, f"part{part}")
    fit = stored.fits(stored.stored_statistics(spark, path))
    out = prep.zscore(prep.impute(p, fit=fit), fit=fit).groupBy("series_id", "feature", "split").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return rounded(rounded(out, "total", digits=3), "top", digits=4)


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""SELECT feature, count(*) AS n, {r('sum(value)', 2)} AS total FROM (
SELECT unnest({LINE_FEATURES}) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) GROUP BY 1""")
def unpivot_features(spark, sf_dir):
    long = prep.to_long(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_FEATURES)
    return rounded(long.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query(f"""SELECT series_id, split, t, {r("max(value) FILTER (feature = 'click')")} AS click, {r("max(value) FILTER (feature = 'view')")} AS view FROM imp GROUP BY ALL""")
def pivot_features(spark, sf_dir):
    wide = prep.to_wide(imputed(spark, sf_dir), ["series_id", "split", "t"], ["click", "view"])
    return rounded(wide, "click", "view")


@query("""SELECT feature, n_series, n_series = 1 + (SELECT count(DISTINCT series_id) FROM raw_) AS common FROM (SELECT feature, count(*) AS n_series FROM (SELECT DISTINCT series_id, feature FROM (
SELECT series_id, feature FROM pts UNION ALL SELECT 'orders', o_orderpriority FROM orders)) GROUP BY 1)""")
def feature_sets(spark, sf_dir):
    both = prep.clean_missing(raw_points(spark, sf_dir)).unionByName(series.order_points(table(spark, sf_dir, "orders")))
    return profile.feature_sets(both)


@query("SELECT count(*) AS n, count(click) AS n_click, count(ship) AS n_ship FROM (SELECT max(value) FILTER (feature = 'click') AS click, NULL AS ship FROM imp GROUP BY series_id, split, t UNION ALL SELECT NULL, v FROM lc)")
def combine_ragged_series(spark, sf_dir):
    a = prep.to_wide(imputed(spark, sf_dir), ["series_id", "split", "t"], ["click"])
    b = series.line_points(table(spark, sf_dir, "lineitem")).where("value is not null").select("series_id", "t", F.col("value").alias("ship"))
    return profile.combine_series([a, b]).agg(F.count("*").alias("n"), F.count("click").alias("n_click"), F.count("ship").alias("n_ship"))


# --- windows


@query(f"SELECT series_id, split, feature, t, len(ctx) AS n_ctx, len(fut) AS n_fut, {r('list_sum(ctx)', 4)} AS ctx_sum, {r('list_sum(fut)', 4)} AS fut_sum FROM win")
def sliding_windows(spark, sf_dir):
    w = scaled_windows(spark, sf_dir)
    out = w.select("series_id", "split", "feature", "t", F.size("ctx").alias("n_ctx"), F.size("fut").alias("n_fut"), total(F.col("ctx")).alias("ctx_sum"), total(F.col("fut")).alias("fut_sum"))
    return rounded(out, "ctx_sum", "fut_sum", digits=4)


@query("SELECT series_id, split, feature, count(*) AS n FROM win WHERE inner_ AND (t - 24) % 5 = 0 GROUP BY ALL")
def sampled_origins(spark, sf_dir):
    w = windows.sliding_windows(scaled(spark, sf_dir).drop("at"), C, H, inner=True)
    return windows.sample_origins(w, C, 5).groupBy("series_id", "split", "feature").agg(F.count("*").alias("n"))


@query("SELECT series_id, feature, t // 7 AS window_id, min(t) AS origin, count(*) AS steps, max(t % 7 + 1)::INTEGER AS last_step FROM pts WHERE split = 'test' GROUP BY ALL")
def block_windows(spark, sf_dir):
    b = windows.block_origins(points(spark, sf_dir).where("split = 'test'"), 7)
    return b.groupBy("series_id", "feature", "window_id").agg(F.min("origin").alias("origin"), F.count("*").alias("steps"), F.max("step").alias("last_step"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT g) AS n_steps, coalesce(min(g) >= 0, true) AS rising, count(DISTINCT g) <= 1 AS regular FROM (
SELECT user_id, epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))::BIGINT AS g FROM events) GROUP BY 1""")
def regular_grid_check(spark, sf_dir):
    return windows.grid_check(table(spark, sf_dir, "events"), ["user_id"], "ts")


# --- forecasts


_SES_POINT = "list_sum(list_transform(range(1, 25), lambda i: ctx[i] * CASE WHEN i = 1 THEN pow(0.7, 23) ELSE 0.3 * pow(0.7, 24 - i) END))"


def _forecast_query(name: str, point: str, method: str, **options) -> None:
    def run(spark, sf_dir):
        f = forecast(scaled_windows(spark, sf_dir), method, C, H, quantiles=False, **options)
        return rounded(f.select("series_id", "split", "feature", "origin", "step", "t", "point"), "point", digits=5)

    run.__name__ = name
    query(f"SELECT series_id, split, feature, t AS origin, j::INTEGER AS step, t + j - 1 AS t, {r(point, 5)} AS point FROM (SELECT *, unnest([1, 2, 3, 4]) AS j FROM q)")(run)


_forecast_query("forecast_naive", "ctx[24]", "naive_last")
_forecast_query("forecast_rolling_mean", "m", "rolling_mean")
_forecast_query("forecast_rolling_median", "q50", "rolling_median")
_forecast_query("forecast_drift", "ctx[24] + (ctx[24] - ctx[1]) / 23 * j", "drift")
_forecast_query("forecast_seasonal_naive", f"ctx[25 - {SEASON} + (j - 1) % {SEASON}]", "seasonal_naive", season=SEASON)
_forecast_query(
    "forecast_ses",
    _SES_POINT,
    "ses",
    alpha=ALPHA,
)
_forecast_query("forecast_flip", "m", "rolling_mean", flip=True, normalize=True)


_SES_GAPS = f"""list_transform(range(2, 25), lambda i: ctx[i] - list_sum(list_transform(range(1, i), lambda k:
  ctx[k] * CASE WHEN k = 1 THEN pow({1 - ALPHA}, i - 2) ELSE {ALPHA} * pow({1 - ALPHA}, i - 1 - k) END)))"""
_LINE_GAPS = "list_transform(range(2, 25), lambda i: ctx[i] - ctx[i - 1] - CASE WHEN i > 2 THEN (ctx[i - 1] - ctx[1]) / (i - 2) ELSE 0 END)"


def _band_query(name: str, method: str, point: str, gaps: str, wider: str, **options) -> None:
    """The band from the method's errors within the context: its means by series, feature and step."""

    def run(spark, sf_dir):
        f = forecast(scaled_windows(spark, sf_dir), method, C, H, **options)
        sums = f.groupBy("series_id", "feature", "step").agg(
            F.count("*").alias("n"), F.avg("q10").alias("low"), F.avg("q50").alias("middle"), F.avg("q90").alias("high"), F.avg(F.col("q90") - F.col("q10")).alias("width")
        )
        return rounded(sums, "low", "middle", "high", "width", digits=4)

    run.__name__ = name
    q = lambda p: f"p + list_aggregate(e, 'quantile_cont', {p}) * {wider}"
    query(f""", be AS (SELECT series_id, feature, {point} AS p, j, {gaps} AS e FROM (SELECT *, unnest([1, 2, 3, 4]) AS j FROM q)),
bq AS (SELECT series_id, feature, j, {q(0.1)} AS a, {q(0.5)} AS b, {q(0.9)} AS c FROM be)
SELECT series_id, feature, j::INTEGER AS step, count(*) AS n, {r('avg(a)', 4)} AS low, {r('avg(b)', 4)} AS middle, {r('avg(c)', 4)} AS high, {r('avg(c - a)', 4)} AS width FROM bq GROUP BY ALL""")(run)


_band_query("forecast_ses_band", "ses", _SES_POINT, _SES_GAPS, f"sqrt(1 + (j - 1) * {ALPHA * ALPHA})", alpha=ALPHA)
_band_query("forecast_drift_band", "drift", "ctx[24] + (ctx[24] - ctx[1]) / 23 * j", _LINE_GAPS, "sqrt(j * (1 + j / 23))")


@query(f"SELECT series_id, split, feature, t AS origin, j::INTEGER AS step, {r('q10', 5)} AS q10, {r('q50', 5)} AS q50, {r('q90', 5)} AS q90 FROM (SELECT *, unnest([1, 2, 3, 4]) AS j FROM q)")
def forecast_quantiles(spark, sf_dir):
    f = forecast(scaled_windows(spark, sf_dir), "rolling_mean", C, H)
    return rounded(f.select("series_id", "split", "feature", "origin", "step", "q10", "q50", "q90"), "q10", "q50", "q90", digits=5)


@query(f"SELECT series_id, split, feature, t AS origin, j::INTEGER AS step, {r('m', 5)} AS point FROM (SELECT *, unnest([1, 2, 3, 4]) AS j FROM q)")
def forecast_udf(spark, sf_dir):
    def load():
        def model(ctx):
            return ctx.mean(axis=1, keepdims=True).repeat(H, axis=1)

        return model

    f = apply_model(scaled_windows(spark, sf_dir), load, H)
    return rounded(f.select("series_id", "split", "feature", "origin", "step", "point"), "point", digits=5)


@query(f"""SELECT series_id, split, feature, t AS origin, j::INTEGER AS step, {r('m + 0.1 * v', 5)} AS point FROM (
SELECT a.series_id, a.split, a.feature, a.t, j, a.m, b.value AS v FROM (
  SELECT *, unnest([1, 2, 3, 4]) AS j FROM (
    SELECT series_id, split, feature, t, max(t) OVER (PARTITION BY series_id, split) AS last_t,
      avg(value) OVER (PARTITION BY series_id, split ORDER BY t RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m FROM z) WHERE t >= 1 AND t + 3 <= last_t AND feature <> 'view') a
JOIN (SELECT * FROM z WHERE feature = 'view') b ON b.series_id = a.series_id AND b.split = a.split AND b.t = a.t + a.j - 1)""")
def forecast_joint_model(spark, sf_dir):
    """A model of all features: the mean of what their contexts hold, and a share of a covariate known ahead; contexts from one step on."""

    def load():
        def model(w):
            level = np.nanmean(w.values, axis=(1, 2))
            return np.repeat((level[:, None, None] + 0.1 * w.future), len(w.features) - 1, axis=1)

        return model

    f = apply_joint_model(scaled(spark, sf_dir).drop("at"), load, C, H, known=("view",), least=1)
    return rounded(f.select("series_id", "split", "feature", "origin", "step", "point"), "point", digits=5)


@query(f"SELECT series_id, t, {r('y', 4)} AS y, {r('point', 4)} AS point FROM cfp")
def forecast_covariate(spark, sf_dir):
    f = covariate_forecast(imputed(spark, sf_dir), "click", "view", 24)
    return rounded(f.select("series_id", "t", "y", "point"), "y", "point", digits=4)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _others(target: str) -> list[str]:
    return [f for f in EVENT_TYPES if f != target]


@query(f", {covariates_ctes('cc', 'click', _others('click'))} SELECT series_id, 'click' AS feature, t // 24 AS window_id, t, {r('y', 4)} AS y, {r('point', 4)} AS point FROM cc")
def forecast_covariates(spark, sf_dir):
    f = covariates_forecast(cut(imputed(spark, sf_dir)), "click", 24)
    return rounded(f.select("series_id", "feature", "window_id", "t", "y", "point"), "y", "point", digits=4)


def _joint_ctes(features: list[str]) -> str:
    """CTEs that end in ``jf``: each feature from the values of all features one step before, fitted to the train split."""
    parts = []
    for i, target in enumerate(features):
        lagged = f"j{i} AS (SELECT series_id, split, t, 'now' AS feature, value FROM z WHERE feature = '{target}' UNION ALL SELECT series_id, split, t + 1, feature, value FROM z)"
        parts.append(f"{lagged}, {covariates_ctes(f'j{i}c', 'now', features, 1 << 40, f'j{i}', JOINT_RIDGE)}")
    union = " UNION ALL ".join(f"SELECT series_id, '{f}' AS feature, t, y, point FROM j{i}c" for i, f in enumerate(features))
    return f"{', '.join(parts)}, jf AS ({union})"


JOINT_RIDGE = 0.01


@query(f", {_joint_ctes(EVENT_TYPES)} SELECT series_id, feature, t, {r('y', 4)} AS y, {r('point', 4)} AS point FROM jf WHERE y IS NOT NULL AND point IS NOT NULL")
def forecast_joint(spark, sf_dir):
    """Each feature from all features one step before."""
    f = joint_forecast(scaled(spark, sf_dir).drop("at"), 1, lags=1, ridge=JOINT_RIDGE)
    return rounded(f.where("split = 'test' AND point IS NOT NULL").select("series_id", "feature", "t", "y", "point"), "y", "point", digits=4)


#: Far from 0, and a power of two, so that values in 64ths stay exact when it is added.
OFFSET = float(1 << 30)


def _gap_by_series(f: DataFrame) -> DataFrame:
    gap = F.abs(F.col("y") - F.col("point"))
    out = f.groupBy("series_id").agg(F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("largest_gap"))
    return rounded(rounded(out, "mean_gap", digits=4), "largest_gap", digits=3)


_GAPS = f"count(abs(y - point)) AS n, {r('avg(abs(y - point))', 4)} AS mean_gap, {r('max(abs(y - point))', 3)} AS largest_gap"


@query(f""", far AS (SELECT * REPLACE (round(value * 64) / 64 AS value) FROM imp), {covariates_ctes('cc', 'click', _others('click'), source='far')} SELECT series_id, {_GAPS} FROM cc GROUP BY 1""")
def forecast_covariates_far(spark, sf_dir):
    """Values of a billion and more: the fits are those of the values without the offset."""
    far = imputed(spark, sf_dir).withColumn("value", F.round(F.col("value") * 64) / 64 + F.lit(OFFSET))
    return _gap_by_series(covariates_forecast(far, "click", 24))


@query(f"""SELECT series_id, {_GAPS} FROM (
SELECT a.series_id, a.t, any_value(a.y) AS y, CASE WHEN var_pop(b.x) > 0 THEN avg(b.y) + covar_pop(b.y, b.x) / var_pop(b.x) * (any_value(a.x) - avg(b.x)) ELSE avg(b.y) END AS point
FROM (SELECT *, round(y0 * 64) / 64 AS y, round(x0 * 64) / 64 AS x FROM (SELECT * RENAME (y AS y0, x AS x0) FROM pw)) a
JOIN (SELECT series_id, w, round(y * 64) / 64 AS y, round(x * 64) / 64 AS x FROM pw) b ON b.series_id = a.series_id AND b.w < a.w WHERE a.split = 'test' GROUP BY a.series_id, a.t) GROUP BY 1""")
def forecast_covariate_far(spark, sf_dir):
    far = imputed(spark, sf_dir).withColumn("value", F.round(F.col("value") * 64) / 64 + F.lit(OFFSET))
    return _gap_by_series(covariate_forecast(far, "click", "view", 24))


@query(f"""SELECT series_id, split, feature, t AS origin, j::INTEGER AS step, {r('greatest(ctx[24] + (ctx[24] - ctx[1]) / 23 * j, 0.0)', 5)} AS point FROM (
SELECT *, unnest([1, 2, 3, 4]) AS j FROM (SELECT series_id, split, feature, t, list(value) OVER (PARTITION BY series_id, split, feature ORDER BY t {LAGS}) AS ctx,
count(*) OVER (PARTITION BY series_id, split, feature ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM imp) WHERE len(ctx) = 24 AND n = 4)""")
def forecast_non_negative(spark, sf_dir):
    """No event value is negative, so no forecast may be."""
    w = windows.sliding_windows(imputed(spark, sf_dir).drop("at"), C, H).drop("value")
    f = forecast(w, "drift", C, H, quantiles=False, non_negative=True)
    return rounded(f.select("series_id", "split", "feature", "origin", "step", "point"), "point", digits=5)


# --- scores


def _score_query(name: str, method: str, sql: str) -> None:
    def run(spark, sf_dir):
        g = gaps(spark, sf_dir, inner=False).where("step = 1")
        s = errors.score(method, F.col("y"), F.col("q50"), F.col("q10"), F.col("q90"))
        return rounded(g.select("series_id", "split", "feature", "t", s.alias("score")), "score", digits=4)

    run.__name__ = name
    query(f"SELECT series_id, split, feature, t, {r(sql, 4)} AS score FROM (SELECT *, fut[1] AS y FROM q)")(run)


_score_query("score_mse", "mse", "(y - q50) * (y - q50)")
_score_query("score_interval", "interval", "greatest(y - q90, 0.0) + greatest(q10 - y, 0.0)")
_score_query("score_normdev", "normalized_deviation", "abs(y - q50) / (q90 - q10 + 1e-8)")
_score_query("score_smape", "smape", "2 * abs(y - q50) / (abs(y) + abs(q50) + 1e-8)")


@query(f"SELECT series_id, split, feature, t AS origin, {r('err', 4)} AS err FROM err")
def window_errors(spark, sf_dir):
    return rounded(scaled_errors(spark, sf_dir), "err", digits=4)


@query(f"SELECT series_id, feature, t, {r('score', 4)} AS score FROM sc")
def calibrate(spark, sf_dir):
    return rounded(feature_scores(spark, sf_dir).select("series_id", "feature", "t", "score"), "score", digits=4)


@query(f"SELECT series_id, t, {r('score', 5)} AS score FROM mse_")
def window_mse(spark, sf_dir):
    g = gaps(spark, sf_dir, inner=False).where("split = 'test'")
    return rounded(scoring.window_mse(g).select("series_id", F.col("origin").alias("t"), "score"), "score", digits=5)


@query(f"SELECT series_id, t, {r('score', 5)} AS score FROM msed")
def dense_scores(spark, sf_dir):
    return rounded(pl.window_mse_scores(points(spark, sf_dir).drop("at"), C, H), "score", digits=5)


@query(f"""SELECT series_id, feature, t, {r('CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (least(greatest(score, lo), hi) - lo) / (hi - lo) END', 4)} AS score
FROM sc JOIN (SELECT series_id, feature, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM sc GROUP BY ALL) USING (series_id, feature)""")
def robust_normalize(spark, sf_dir):
    return rounded(scoring.robust_normalize(feature_scores(spark, sf_dir)).select("series_id", "feature", "t", "score"), "score", digits=4)


@query(f"""SELECT series_id, feature, t, {r('CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END', 4)} AS score
FROM sc JOIN (SELECT series_id, feature, min(score) AS lo, max(score) AS hi FROM sc GROUP BY ALL) USING (series_id, feature)""")
def minmax_scores(spark, sf_dir):
    return rounded(scoring.minmax_scores(feature_scores(spark, sf_dir)).select("series_id", "feature", "t", "score"), "score", digits=4)


def _combine_query(method: str) -> None:
    def run(spark, sf_dir):
        c = scoring.combine(feature_scores(spark, sf_dir), [method]).withColumnRenamed(method, "score")
        return rounded(c, "score", digits=4)

    run.__name__ = f"agg_{method}"
    quoted = f'"{method}"'
    query(f"SELECT series_id, t, {r(quoted, 4)} AS score FROM comb")(run)


for _method in scoring.AGGREGATIONS:
    _combine_query(_method)


def _smooth_sql(size: int) -> str:
    back, ahead = size // 2, size - size // 2 - 1
    return f"""SELECT series_id, t2 AS t, {r('s', 4)} AS score FROM (SELECT *, avg(score) OVER (PARTITION BY series_id ORDER BY t2 ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) AS s FROM (
SELECT series_id, score, n, unnest([t, -1 - t, 2 * n - 1 - t]) AS t2 FROM msed JOIN (SELECT series_id, max(t) + 1 AS n FROM msed GROUP BY 1) USING (series_id)) WHERE t2 >= -{back} AND t2 < n + {ahead}) WHERE t2 >= 0 AND t2 < n"""


@query(_smooth_sql(5))
def smooth_reflect(spark, sf_dir):
    return rounded(scoring.smooth(pl.window_mse_scores(points(spark, sf_dir).drop("at"), C, H), "score", 5), "score", digits=4).select("series_id", "t", "score")


@query(_smooth_sql(4))
def smooth_reflect_even(spark, sf_dir):
    return rounded(scoring.smooth(pl.window_mse_scores(points(spark, sf_dir).drop("at"), C, H), "score", 4), "score", digits=4).select("series_id", "t", "score")


# --- evaluation


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window errors from step C on, with labels; rounded, so that scores that are equal but for the order of a sum tie."""
    s = metrics.trim_after_context(pl.window_mse_scores(points(spark, sf_dir).drop("at"), C, H), C)
    return cut(rounded(s, "score", digits=DIGITS).join(pl.test_labels(labels(spark, sf_dir)), ["series_id", "t"]))


@query(f"SELECT series_id, {r('auroc')} AS auroc FROM m_a")
def auroc(spark, sf_dir):
    return rounded(metrics.areas(evaluated(spark, sf_dir), ["series_id"]).select("series_id", "auroc"), "auroc")


@query(f"SELECT series_id, {r('auprc')} AS auprc FROM m_a")
def average_precision(spark, sf_dir):
    return rounded(metrics.areas(evaluated(spark, sf_dir), ["series_id"]).select("series_id", "auprc"), "auprc")


@query(f"SELECT series_id, {r('fpr')} AS fpr, {r('tpr')} AS tpr, {r('threshold', 5)} AS threshold FROM m_r")
def roc_curve(spark, sf_dir):
    return _round_curve(metrics.roc_curve(evaluated(spark, sf_dir), ["series_id"]), "fpr", "tpr")


def _round_curve(curve: DataFrame, *columns: str) -> DataFrame:
    """Infinity cannot be rounded."""
    t = F.col("threshold")
    return rounded(curve, *columns).withColumn("threshold", F.when(t == float("inf"), t).otherwise(rounded_to(F.nullif(t, F.lit(float("inf"))), 5) + F.lit(0.0)))


@query(f"""SELECT series_id, {r('CASE WHEN np > 0 THEN tp::DOUBLE / np END')} AS recall, {r('tp::DOUBLE / (tp + fp)')} AS "precision", {r('score', 5)} AS threshold FROM m_c
UNION ALL SELECT DISTINCT series_id, 0.0, 1.0, NULL FROM m_c""")
def pr_curve(spark, sf_dir):
    return _round_curve(metrics.pr_curve(evaluated(spark, sf_dir), ["series_id"]), "recall", "precision")


@query(f"SELECT series_id, {r('threshold', 5)} AS best_threshold, {r('tpr')} AS best_tpr, {r('fpr')} AS best_fpr FROM m_j")
def youden(spark, sf_dir):
    best = metrics.youden(metrics.roc_curve(evaluated(spark, sf_dir), ["series_id"]), ["series_id"]).withColumnRenamed("best_threshold", "threshold")
    return _round_curve(best, "best_tpr", "best_fpr").withColumnRenamed("threshold", "best_threshold")


def _confusion(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    """Alarms at the fixed threshold 1.5."""
    flagged = evaluated(spark, sf_dir)
    fixed = flagged.select("series_id").distinct().withColumn("best_threshold", F.lit(1.5))
    return rounded(metrics.confusion(metrics.alarms(flagged, fixed, ["series_id"], strict), ["series_id"]), "precision", "recall", "f1")


def _confusion_sql(op: str) -> str:
    return f"""SELECT *, {r('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS "precision", {r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall,
{r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)')} AS f1 FROM (
SELECT series_id, count(*) FILTER (y = 0 AND NOT a) AS tn, count(*) FILTER (y = 0 AND a) AS fp, count(*) FILTER (y = 1 AND NOT a) AS fn, count(*) FILTER (y = 1 AND a) AS tp
FROM (SELECT *, score {op} 1.5 AS a FROM mev) GROUP BY 1)"""


@query(_confusion_sql(">="))
def confusion(spark, sf_dir):
    return _confusion(spark, sf_dir, strict=False)


@query(_confusion_sql(">"))
def confusion_strict(spark, sf_dir):
    return _confusion(spark, sf_dir, strict=True)


@query(f"SELECT series_id, split, {r('avg(y)')} AS anomaly_ratio FROM lab GROUP BY ALL")
def anomaly_ratio(spark, sf_dir):
    return rounded(metrics.anomaly_ratio(labels(spark, sf_dir), ["series_id", "split"]), "anomaly_ratio")


@query("SELECT series_id, count(*) AS n FROM msed JOIN (SELECT series_id, max(t) + 1 AS n_ FROM msed GROUP BY 1) USING (series_id) WHERE t >= 24 AND t < n_ - 4 GROUP BY 1")
def trim_full_windows(spark, sf_dir):
    s = pl.window_mse_scores(points(spark, sf_dir).drop("at"), C, H)
    return metrics.trim_full_windows(s, C, H).groupBy("series_id").agg(F.count("*").alias("n"))


@query(f"SELECT series_id, y, count(*) AS n, {r('avg(score)', 5)} AS mean_score FROM mev GROUP BY ALL")
def label_subsets(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir).groupBy("series_id", "y").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")), "mean_score", digits=5)


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, so that scores that are equal but for the order of a sum tie."""
    return rounded(pl.calibrated(points(spark, sf_dir).drop("at"), labels(spark, sf_dir), C, H), *pl.CALIBRATED, digits=4)


@query(f"""SELECT series_id, method AS best_method, {r('auroc')} AS best_auroc FROM (
SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY auroc DESC, list_position(['max', 'topk', 'l2', 'mae'], method)) AS k FROM k_a WHERE auroc > 0) WHERE k = 1""")
def best_method(spark, sf_dir):
    long = cut(calibrated_scores(spark, sf_dir).unpivot(["series_id", "t", "y"], pl.CALIBRATED, "method", "score"))
    return rounded(metrics.best_method(metrics.areas(long, ["series_id", "method"]), pl.CALIBRATED, ["series_id"]), "best_auroc")


@query(f"SELECT {r('avg(auroc)')} AS mean_auroc, {r('avg(auprc)')} AS mean_auprc FROM m_a")
def mean_metrics(spark, sf_dir):
    return rounded(metrics.mean_metrics(metrics.areas(evaluated(spark, sf_dir), ["series_id"])), "mean_auroc", "mean_auprc")


# --- pipelines


@query(f"""SELECT series_id, t, {r('"max"', 4)} AS score_max, {r('topk', 4)} AS score_topk, {r('l2', 4)} AS score_l2, {r('mae', 4)} AS score_mae, y FROM cev""")
def pipeline_calibrated(spark, sf_dir):
    s = calibrated_scores(spark, sf_dir).select("series_id", "t", *(F.col(m).alias(f"score_{m}") for m in pl.CALIBRATED), "y")
    return s


@query(f"""SELECT a.series_id, a.method, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc FROM k_a a""")
def pipeline_calibrated_metrics(spark, sf_dir):
    m = pl.method_metrics(calibrated_scores(spark, sf_dir), pl.CALIBRATED)
    return rounded(m.select("series_id", "method", "auroc", "auprc"), "auroc", "auprc", digits=5)


@query(f"""SELECT a.series_id, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc, {r('tpr', 5)} AS best_tpr, {r('m_j.fpr', 5)} AS best_fpr, tn, m_f.fp, fn, tp
FROM m_a a JOIN m_j USING (series_id) JOIN m_f USING (series_id)""")
def pipeline_window_mse(spark, sf_dir):
    out = pl.window_mse(points(spark, sf_dir).drop("at"), labels(spark, sf_dir), C, H, digits=DIGITS)
    return rounded(out.select("series_id", "auroc", "auprc", "best_tpr", "best_fpr", "tn", "fp", "fn", "tp"), "auroc", "auprc", "best_tpr", "best_fpr", digits=5)


@query(f"SELECT series_id, {r('auroc', 4)} AS auroc, {r('auprc', 4)} AS auprc FROM b_a")
def pipeline_band(spark, sf_dir):
    out = pl.band(imputed(spark, sf_dir), labels(spark, sf_dir), C, H, digits=DIGITS)
    return rounded(out, "auroc", "auprc", digits=4)


@query(f"SELECT series_id, t, {r('score', 4)} AS score FROM bsm")
def band_scores(spark, sf_dir):
    return rounded(pl.band_scores(imputed(spark, sf_dir), C, H), "score", digits=4).select("series_id", "t", "score")


@query(f"SELECT series_id, {r('auroc', 4)} AS auroc, {r('auprc', 4)} AS auprc FROM v_a")
def pipeline_covariate(spark, sf_dir):
    out = pl.covariate(imputed(spark, sf_dir), labels(spark, sf_dir), 24, {"click": "view"}, digits=DIGITS)
    return rounded(out, "auroc", "auprc", digits=4)


@query(f""", {covariates_ctes('c1', 'click', _others('click'))}, {covariates_ctes('c2', 'view', _others('view'))},
c3 AS (SELECT 'click' AS feature, * FROM c1 UNION ALL SELECT 'view', * FROM c2), c4 AS (SELECT series_id, feature, t, (y - point) * (y - point) AS s FROM c3),
c5 AS (SELECT series_id, t, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END AS s FROM c4 JOIN (SELECT series_id, feature, min(s) AS lo, max(s) AS hi FROM c4 GROUP BY ALL) USING (series_id, feature)),
c6 AS (SELECT series_id, t, round(sqrt(sum(s * s)), 5) AS score, any_value(y) AS y FROM c5 JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, t) GROUP BY ALL),
{_metrics("c7", "c6", "series_id")} SELECT series_id, {r('auroc', 3)} AS auroc, {r('auprc', 3)} AS auprc FROM c7_a""")
def pipeline_covariates(spark, sf_dir):
    """Each of two targets from all other features."""
    out = pl.covariate(imputed(spark, sf_dir), labels(spark, sf_dir), 24, ["click", "view"], digits=DIGITS)
    return rounded(out, "auroc", "auprc", digits=3)


@query(f"SELECT series_id, context, horizon, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc FROM ({' UNION ALL '.join(f'({sweep_part(c, h)})' for c, h in SWEEP)})")
def sweep(spark, sf_dir):
    out = pl.sweep(points(spark, sf_dir).drop("at"), labels(spark, sf_dir), SWEEP, digits=DIGITS)
    return rounded(out.select("series_id", "context", "horizon", "auroc", "auprc"), "auroc", "auprc", digits=5)


@query(f"""SELECT series_id, t, {r('"max"', 4)} AS score_max, {r('topk', 4)} AS score_topk, {r('l2', 4)} AS score_l2, y AS is_anomaly, 5 AS n_features, {r('s', 4)} AS ctx_sum
FROM cev JOIN (SELECT series_id, t, sum(list_sum(ctx)) AS s FROM win WHERE split = 'test' GROUP BY ALL) USING (series_id, t) WHERE (t - 24) % 5 = 0""")
def window_records(spark, sf_dir):
    w = pl.window_records(points(spark, sf_dir).drop("at"), labels(spark, sf_dir), C, H)
    sums = F.aggregate("context_values", F.lit(0.0), lambda a, c: a + total(c))
    out = w.select("series_id", "t", "score_max", "score_topk", "score_l2", "is_anomaly", F.size("feature_scores").alias("n_features"), sums.alias("ctx_sum"))
    return rounded(out, "score_max", "score_topk", "score_l2", "ctx_sum", digits=4)


_STREAM_ERR = f"""SELECT series_id, feature, t, abs(value - list_avg(ctx)) / greatest((list_aggregate(ctx, 'quantile_cont', 0.9) - list_aggregate(ctx, 'quantile_cont', 0.1)) / 2.56, 0.001) AS err FROM (
SELECT 's' || (user_id // 25) AS series_id, event_type AS feature, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS t, value,
list(value) OVER (PARTITION BY user_id // 25, event_type ORDER BY ts {LAGS}) AS ctx FROM events) WHERE len(ctx) = 24"""
#: Microseconds of the events that calibrate.
_CALIBRATES = 6 * 86_400_000_000


def _streamed(spark: SparkSession, sf_dir: str, calibration: DataFrame, before: int | None = None, **options) -> DataFrame:
    """All events as a stream, or those ``before`` a time, each scored against the 24 before it in its series and type."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parquet*")
    arrivals = events.select(
        F.concat(F.lit("s"), F.floor(F.col("user_id") / 25).cast("string")).alias("series_id"), F.col("event_type").alias("feature"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("t"), F.col("value").alias("y"), F.col("ts").cast("timestamp").alias("ts"),
    )
    arrivals = arrivals if before is None else arrivals.where(F.col("t") < before)
    out = shared_path(spark)
    run = online_scores(arrivals, calibration, C, **options).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out)


@query(f", e AS ({_STREAM_ERR}) SELECT series_id, feature, t, {r('err', 4)} AS score FROM e")
def stream_scores(spark, sf_dir):
    """Not calibrated."""
    none = spark.range(0).selectExpr("'' AS series_id", "'' AS feature", "0D AS mu", "1D AS sd")
    return rounded(_streamed(spark, sf_dir, none).select("series_id", "feature", "t", "score"), "score", digits=4)


@query(f""", e AS ({_STREAM_ERR}), ec AS (SELECT series_id, feature, avg(err) AS mu, stddev_pop(err) + 1e-8 AS sd FROM e WHERE t < {_CALIBRATES} GROUP BY ALL HAVING count(*) > 4)
SELECT series_id, feature, t, {r('(err - coalesce(mu, 0)) / coalesce(sd, 1)', 3)} AS score FROM e LEFT JOIN ec USING (series_id, feature)
WHERE (t // 1000) <= (SELECT max(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)) // 1000 - 86400000 FROM events)""")
def stream_scores_calibrated(spark, sf_dir):
    """Against the errors of the first six days, in event-time order behind a watermark of a day: the last day waits for later arrivals."""
    none = spark.range(0).selectExpr("'' AS series_id", "'' AS feature", "0D AS mu", "1D AS sd")
    # no later event bears on the errors of the first days
    first = _streamed(spark, sf_dir, none, before=_CALIBRATES)
    fit = first.groupBy("series_id", "feature").agg(F.avg("err").alias("mu"), (F.stddev_pop("err") + errors.EPSILON).alias("sd"), F.count("*").alias("n")).where("n > 4").drop("n")
    return rounded(_streamed(spark, sf_dir, cut(fit), delay="1 day").select("series_id", "feature", "t", "score"), "score", digits=3)


# --- files: series in, results out and back


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event series with the sentinel and the label, one column a feature."""
    long = prep.split_by_position(series.event_points(table(spark, sf_dir, "events"), length="n"), length="n")
    wide = prep.to_wide(long, ["series_id", "split", "t"], EVENT_TYPES)
    return wide.join(labels(spark, sf_dir).withColumnRenamed("y", "is_anomaly"), ["series_id", "split", "t"])


def _from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of CSV series, written and read back."""
    path = shared_path(spark)
    sinks.write_csv_series(_wide(spark, sf_dir), path)
    schema = ", ".join(["timestamp timestamp_ntz", *(f"`{f}` double" for f in EVENT_TYPES), "is_anomaly int"])
    return series.read_csv_series(spark, path, schema)


@query(f"SELECT series_id, split, t, feature, {r('value')} AS value FROM pts")
def csv_series(spark, sf_dir):
    long, _ = prep.features_and_labels(_from_csv(spark, sf_dir), ["series_id", "split", "t"], require=True)
    return rounded(prep.clean_missing(long), "value").select("series_id", "split", "t", "feature", "value")


@query(f"""SELECT series_id, split, t, feature, {r("CASE WHEN k = 2 AND feature = 'click' THEN NULL ELSE value END")} AS value FROM (SELECT *, CAST(substr(series_id, 2) AS BIGINT) % 3 AS k FROM pts)
UNION ALL SELECT series_id, split, t, 'other', CASE WHEN CAST(substr(series_id, 2) AS BIGINT) % 3 = 2 THEN t::DOUBLE END FROM (SELECT DISTINCT series_id, split, t FROM pts)""")
def csv_mixed_columns(spark, sf_dir):
    """Three directories in one read: columns in one order, in the reverse order, and with one lacking and another more."""
    wide = cut(_wide(spark, sf_dir).withColumn("k", F.substring("series_id", 2, 18).cast("long") % 3))
    ids, names = ["series_id", "split", "t"], [*EVENT_TYPES, "is_anomaly"]
    parts = [wide.select(*ids, *names, "k"), wide.select(*ids, *reversed(names), "k"), wide.select(*ids, F.col("t").cast("double").alias("other"), *(n for n in names if n != "click"), "k")]
    paths = [shared_path(spark) for _ in parts]
    for i, (part, path) in enumerate(zip(parts, paths)):
        sinks.write_csv_series(part.where(F.col("k") == i).drop("k"), path)
    long, _ = prep.features_and_labels(series.read_csv_series(spark, paths), ids, require=True)
    return rounded(prep.clean_missing(long), "value").select("series_id", "split", "t", "feature", "value")


@query(f"SELECT series_id, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc, {r('tpr', 5)} AS best_tpr, {r('m_j.fpr', 5)} AS best_fpr FROM m_a JOIN m_j USING (series_id)")
def csv_pipeline(spark, sf_dir):
    """From a directory of CSV files to the summary by series, written as CSV and read back."""
    long, y = prep.features_and_labels(cut(_from_csv(spark, sf_dir)), ["series_id", "split", "t"], require=True)
    out = pl.window_mse(prep.clean_missing(long), y.withColumnRenamed("is_anomaly", "y"), C, H, digits=DIGITS)
    path, columns = shared_path(spark), ["auroc", "auprc", "best_tpr", "best_fpr"]
    sinks.write_summary(out.select("series_id", *columns), path)
    back = spark.read.schema("series_id string, " + ", ".join(f"{c} double" for c in columns)).option("header", True).csv(path)
    return rounded(back, *columns, digits=5)


@query(f"SELECT series_id AS file_name, {r('auroc', 5)} AS \"AUROC\", {r('auprc', 5)} AS \"AUPRC\" FROM m_a")
def saved_results(spark, sf_dir):
    """A results table, made if absent (twice), and appended to by parts."""
    path = shared_path(spark)
    found = cut(metrics.areas(evaluated(spark, sf_dir), ["series_id"]).select(F.col("series_id").alias("file_name"), F.col("auroc").alias("AUROC"), F.col("auprc").alias("AUPRC")))
    even = F.pmod(F.xxhash64("file_name"), F.lit(2)) == 0
    for part in (found.where(even), found.where(~even)):
        sinks.create_results(spark, path)
        sinks.append_results(part, path)
    return rounded(spark.read.parquet(path), "AUROC", "AUPRC", digits=5)


@query(f"SELECT series_id, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc FROM m_a")
def saved_in_waves(spark, sf_dir):
    """Evaluation in three waves of series, cut off in the second, and run again."""
    path, scored, calls = shared_path(spark), cut(evaluated(spark, sf_dir)), []

    def areas(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise InterruptedError
        return metrics.areas(rows, ["series_id"])

    with contextlib.suppress(InterruptedError):
        commits.run_in_waves(scored, ["series_id"], path, areas, waves=3)
    commits.run_in_waves(scored, ["series_id"], path, areas, waves=3)
    return rounded(commits.read_committed(spark, path, "series_id string, auroc double, auprc double"), "auroc", "auprc", digits=5)


@query(f"""SELECT 'roc' AS curve, series_id, {r('fpr')} AS x, {r('tpr')} AS y, {r('threshold', 5)} AS threshold FROM m_r
UNION ALL SELECT 'pr', series_id, {r('CASE WHEN np > 0 THEN tp::DOUBLE / np END')}, {r('tp::DOUBLE / (tp + fp)')}, {r('score', 5)} FROM m_c UNION ALL SELECT DISTINCT 'pr', series_id, 0.0, 1.0, NULL::DOUBLE FROM m_c""")
def saved_curves(spark, sf_dir):
    scored, paths = evaluated(spark, sf_dir), [shared_path(spark), shared_path(spark)]
    sinks.write_curve(metrics.roc_curve(scored, ["series_id"]), paths[0])
    sinks.write_curve(metrics.pr_curve(scored, ["series_id"]), paths[1])
    roc = spark.read.parquet(paths[0]).select(F.lit("roc").alias("curve"), "series_id", F.col("fpr").alias("x"), F.col("tpr").alias("y"), "threshold")
    pr = spark.read.parquet(paths[1]).select(F.lit("pr").alias("curve"), "series_id", F.col("recall").alias("x"), F.col("precision").alias("y"), "threshold")
    return _round_curve(roc.unionByName(pr), "x", "y")


@query(f"SELECT series_id, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc FROM k_a WHERE method = 'l2'")
def saved_scores(spark, sf_dir):
    """Scores of all methods written by dataset, configuration and method; those of one read back, and evaluated."""
    path = shared_path(spark)
    long = calibrated_scores(spark, sf_dir).unpivot(["series_id", "t"], pl.CALIBRATED, "method", "score")
    sinks.write_scores(long.withColumns({"dataset": F.lit("events"), "context": F.lit(C), "horizon": F.lit(H)}), path)
    back = series.read_scores(spark, path).where((F.col("dataset") == "events") & (F.col("context") == C) & (F.col("method") == "l2"))
    out = pl.evaluate(back.select("series_id", "t", "score"), labels(spark, sf_dir), C)
    return rounded(out.select("series_id", "auroc", "auprc"), "auroc", "auprc", digits=5)


@query(f"""SELECT series_id, t, {r('"max"', 4)} AS score_max, y AS is_anomaly FROM cev WHERE (t - 24) % 5 = 0""")
def saved_records(spark, sf_dir):
    path = shared_path(spark)
    sinks.write_window_records(pl.window_records(points(spark, sf_dir).drop("at"), labels(spark, sf_dir), C, H), path)
    return rounded(spark.read.parquet(path).select("series_id", "t", "score_max", "is_anomaly"), "score_max", digits=4)


@query(f"SELECT 'events' AS dataset, true AS dated, series_id, method, {r('auroc', 5)} AS auroc, {r('auprc', 5)} AS auprc FROM k_a")
def saved_method_metrics(spark, sf_dir):
    path = shared_path(spark)
    m = pl.method_metrics(calibrated_scores(spark, sf_dir), pl.CALIBRATED)
    sinks.write_method_metrics(m.select("series_id", "method", "auroc", "auprc"), path, "events")
    back = spark.read.schema("series_id string, method string, auroc double, auprc double, run_date string, dataset string").parquet(path).where("dataset = 'events'")
    out = back.select("dataset", F.col("run_date").rlike(r"^\d{4}-\d\d-\d\d$").alias("dated"), "series_id", "method", "auroc", "auprc")
    return rounded(out, "auroc", "auprc", digits=5)


@query(f"SELECT {r('avg(auroc)', 5)} AS mean_auroc, {r('avg(auprc)', 5)} AS mean_auprc FROM m_a")
def saved_report(spark, sf_dir):
    """The one-row mean report as JSON."""
    path = shared_path(spark)
    sinks.write_report(metrics.mean_metrics(metrics.areas(evaluated(spark, sf_dir), ["series_id"])), path)
    return rounded(spark.read.schema("mean_auroc double, mean_auprc double").json(path), "mean_auroc", "mean_auprc", digits=5)


@query(f"""SELECT CASE WHEN count(*) = count(a) THEN {r('avg(a)', 5)} END AS mean_auroc, CASE WHEN count(*) = count(auprc) THEN {r('avg(auprc)', 5)} END AS mean_auprc
FROM (SELECT *, CASE WHEN series_id <> 's0' THEN auroc END AS a FROM m_a)""")
def mean_metrics_strict(spark, sf_dir):
    """An undefined value makes its mean undefined."""
    a = metrics.areas(evaluated(spark, sf_dir), ["series_id"]).withColumn("auroc", F.when(F.col("series_id") != "s0", F.col("auroc")))
    return rounded(metrics.mean_metrics(a, skip=False), "mean_auroc", "mean_auprc", digits=5)


@query("SELECT DISTINCT series_id, 'events_context24_h4' AS config, 20 AS train_percent, series_id || '_train.csv' AS file FROM pts")
def run_names(spark, sf_dir):
    """Names of configuration and files of every series; the file's name gives the series back."""
    s = points(spark, sf_dir).select("series_id").distinct().withColumn("file", F.concat("series_id", F.lit("_train.csv")))
    config = naming.config_name("events", F.lit(C), F.lit(H))
    return s.select(naming.strip_suffix(F.col("file"), "_train.csv").alias("series_id"), config.alias("config"), F.lit(naming.split_percent(0.2)).alias("train_percent"), "file")


@query("SELECT DISTINCT series_id, t, CAST(0 AS DOUBLE) AS score FROM z WHERE split = 'test' AND t < 27")
def short_series(spark, sf_dir):
    """Series one step shorter than context and horizon have no window: all scores are 0."""
    p = points(spark, sf_dir).drop("at").where(F.col("t") < C + H - 1)
    return pl.window_mse_scores(p, C, H)


# --- profiles


@query(f"SELECT series_id, feature, t, {r('value')} AS value FROM raw_ WHERE t < 5 AND feature IN (SELECT DISTINCT feature FROM raw_ ORDER BY 1 LIMIT 3)")
def preview(spark, sf_dir):
    return rounded(profile.preview(raw_points(spark, sf_dir), 5, 3), "value").select("series_id", "feature", "t", "value")


@query(f"""SELECT series_id, feature, {r('1 - count(value) / count(*)')} AS missing, {r('min(value)')} AS lo, {r('max(value)')} AS hi,
{r('avg(value) FILTER (y = 0)', 4)} AS mean_normal, {r('avg(value) FILTER (y = 1)', 4)} AS mean_anomalous,
{r("stddev_pop(CASE WHEN split = 'train' THEN value END)", 4)} AS train_std, {r("stddev_pop(CASE WHEN split = 'test' THEN value END)", 4)} AS test_std,
{r("abs(avg(CASE WHEN split = 'train' THEN value END) - avg(CASE WHEN split = 'test' THEN value END))", 4)} AS drift,
coalesce(stddev_pop(CASE WHEN split = 'train' THEN value END) > 1e-8, false) AS kept
FROM pts LEFT JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, split, t) GROUP BY ALL""")
def quality_report(spark, sf_dir):
    out = rounded(profile.report(points(spark, sf_dir), labels(spark, sf_dir)), "missing", "lo", "hi")
    return rounded(out, "mean_normal", "mean_anomalous", "train_std", "test_std", "drift", digits=4)



@query(f"""SELECT series_id, feature, {r("stddev_pop(CASE WHEN split = 'train' THEN value END)", 4)} AS train_std, {r("stddev_pop(CASE WHEN split = 'test' THEN value END)", 4)} AS test_std,
{r("abs(avg(CASE WHEN split = 'train' THEN value END) - avg(CASE WHEN split = 'test' THEN value END))", 4)} AS drift FROM pts GROUP BY ALL""")
def drift(spark, sf_dir):
    return rounded(profile.drift(points(spark, sf_dir)), "train_std", "test_std", "drift", digits=4)


@query("""SELECT series_id, feature, split, least(floor(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END * 30) + 1, 30)::INTEGER AS bin, count(*) AS n
FROM lp JOIN (SELECT series_id, feature, split, min(value) AS lo, max(value) AS hi FROM lp GROUP BY ALL) USING (series_id, feature, split) WHERE value IS NOT NULL GROUP BY ALL""")
def feature_histogram(spark, sf_dir):
    return profile.histogram(line_points(spark, sf_dir))


@query(f"SELECT series_id, feature, {r('min(value)')} AS lo, {r('max(value)')} AS hi FROM pts GROUP BY ALL")
def shared_range(spark, sf_dir):
    return rounded(profile.shared_range(points(spark, sf_dir)), "lo", "hi")


@query(f"""SELECT count(*) AS n_series, min(l) AS shortest, max(l) AS longest, {r('avg(l)')} AS mean_length, min(f) AS fewest_features, max(f) AS most_features
FROM (SELECT series_id, count(DISTINCT t) AS l, count(DISTINCT feature) AS f FROM raw_ GROUP BY 1)""")
def series_profile(spark, sf_dir):
    return rounded(profile.collection(raw_points(spark, sf_dir)), "mean_length")


@query("""SELECT series_id, feature FROM (SELECT * REPLACE (CASE WHEN feature = 'view' AND value IS NOT NULL THEN 5.0 ELSE value END AS value) FROM pts) GROUP BY ALL
HAVING NOT coalesce(stddev_pop(CASE WHEN split = 'train' THEN value END) > 1e-8, false)""")
def removed_features(spark, sf_dir):
    p = points(spark, sf_dir)
    flat = p.withColumn("value", F.when((F.col("feature") == "view") & F.col("value").isNotNull(), F.lit(5.0)).otherwise(F.col("value")))
    return profile.removed_features(flat, prep.drop_flat_features(flat))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
