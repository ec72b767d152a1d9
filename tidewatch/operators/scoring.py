"""From forecast gaps to one score a time step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.errors import EPSILON, in_deviations
from tidewatch.operators.prep import KEY
from tidewatch.operators.windows import BLOCK, own_rows, with_halo


def window_errors(gaps: DataFrame) -> DataFrame:
    """Mean over the horizon of |y - point| / uncertainty, one row an origin and feature."""
    e = in_deviations(F.col("y"), F.col("point"), F.col("q10"), F.col("q90"))
    return gaps.groupBy("series_id", "split", "feature", "origin").agg(F.avg(e).alias("err"))


def window_mse(gaps: DataFrame) -> DataFrame:
    """Mean squared error over horizon and features, one row an origin."""
    e = F.col("y") - F.col("point")
    return gaps.groupBy("series_id", "split", "origin").agg(F.avg(e * e).alias("score"))


def calibrate(errors: DataFrame) -> DataFrame:
    """Test errors against the train errors' mean and population deviation (+1e-8) by feature; without train windows against 0 and 1."""
    fit = errors.where("split = 'train'").groupBy(*KEY).agg(F.avg("err").alias("mu"), (F.stddev_pop("err") + EPSILON).alias("sd"))
    out = errors.where("split = 'test'").join(fit, KEY, "left")
    return out.withColumn("score", (F.col("err") - F.coalesce("mu", F.lit(0.0))) / F.coalesce("sd", F.lit(1.0))).drop("mu", "sd", "err")


def robust_normalize(scores: DataFrame, exact: bool = True, fit: DataFrame | None = None) -> DataFrame:
    """Scores clipped to their 1st and 99th percentile by feature, or the p01 and p99 of a stored ``fit`` of earlier scores, and scaled to [0, 1]; a width under 1e-8, or no score, gives 0."""
    q = F.percentile("score", F.array(F.lit(0.01), F.lit(0.99))) if exact else F.percentile_approx("score", F.array(F.lit(0.01), F.lit(0.99)), 10_000)
    own = scores.groupBy(*KEY).agg(q.alias("p")).select(*KEY, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    fit = own if fit is None else fit.select(*KEY, F.col("p01").alias("lo"), F.col("p99").alias("hi"))
    width = F.col("hi") - F.col("lo")
    clipped = F.least(F.greatest(F.col("score"), F.col("lo")), F.col("hi"))
    value = F.when(F.col("score").isNull() | (width < EPSILON), F.lit(0.0)).otherwise((clipped - F.col("lo")) / width)
    return scores.join(fit, KEY).withColumn("score", F.coalesce(value, F.lit(0.0))).drop("lo", "hi")


def minmax_scores(scores: DataFrame) -> DataFrame:
    """Scores by their own range by feature; 0 / 0 gives 0."""
    fit = scores.groupBy(*KEY).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    value = F.coalesce(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return scores.join(fit, KEY).withColumn("score", value).drop("lo", "hi")


def _top_mean(k: Column) -> Column:
    """Mean of the k largest scores of a step, of all if there are fewer. A step has one score a feature, so the list is short."""
    top = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


AGGREGATIONS: dict[str, Callable[[int], Column]] = {
    "max": lambda k: F.max("score"),
    "mean": lambda k: F.avg("score"),
    "l2": lambda k: F.sqrt(F.sum(F.col("score") * F.col("score"))),
    "mae": lambda k: F.avg(F.abs("score")),
    "mse": lambda k: F.avg(F.col("score") * F.col("score")),
    "topk": lambda k: _top_mean(F.lit(k)),
    "topquarter": lambda k: _top_mean(F.greatest(F.lit(1), F.floor(F.max("n_features") / 4)).cast("int")),
}


def combine(scores: DataFrame, methods: list[str], top_k: int = 3, keys: tuple[str, ...] = ("series_id", "t")) -> DataFrame:
    """One column a method, one row a step. 'topquarter' takes a quarter of the series' features, at least one."""
    unknown = [m for m in methods if m not in AGGREGATIONS]
    if unknown:
        raise ValueError(f"unknown aggregation {unknown[0]!r}; known: {', '.join(AGGREGATIONS)}")
    if "topquarter" in methods:
        n = scores.groupBy("series_id").agg(F.count_distinct("feature").alias("n_features"))
        scores = scores.join(n, "series_id")
    return scores.groupBy(*keys).agg(*(AGGREGATIONS[m](top_k).alias(m) for m in methods))


def dense(spine: DataFrame, scores: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series_id", "t")) -> DataFrame:
    """Every step of ``spine``; steps without a score have 0."""
    return spine.join(scores, list(keys), "left").fillna(0.0, columns)


def smooth(scores: DataFrame, column: str, size: int = 5, block: int = BLOCK) -> DataFrame:
    """Centred moving mean with mirrored edges (d c b a | a b c d | d c b a); t counts from 0 without gaps. An even size reaches one step further back; size 1 or less changes nothing."""
    if size <= 1:
        return scores
    back, ahead = size // 2, size - size // 2 - 1
    n = scores.groupBy("series_id").agg((F.max("t") + 1).alias("sm_n"))
    rows = scores.join(n, "series_id")
    t, last = F.col("t"), F.col("sm_n")
    # mirrored places of a step among those that windows at the edges reach, also when the series is shorter than the window
    turns = back // 1 + 1
    places = F.array(*(x for r in range(-turns, turns + 1) for x in (t + 2 * r * last, -1 - t + 2 * r * last)))
    inside = F.filter(places, lambda p: (p >= -back) & (p < last + ahead))
    spread = rows.withColumn("sm_t", F.explode(inside)).withColumn("t", F.col("sm_t") + back)
    w = Window.partitionBy("series_id", "w_block").orderBy("t").rowsBetween(-back, ahead)
    out = own_rows(with_halo(spread, back, ahead, block).withColumn(column, F.avg(column).over(w)), block)
    return out.where((F.col("sm_t") >= 0) & (F.col("sm_t") < F.col("sm_n"))).withColumn("t", F.col("sm_t")).drop("sm_t", "sm_n")
