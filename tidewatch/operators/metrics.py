"""Evaluation of scores against 0/1 labels, by group.

``scored`` has the group's keys, score and y. Rows with equal scores are summed before anything is
sorted. Running counts come from slices of the score (``operators.running``), so a series with
a large share of all rows is not sorted in one task. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.errors import ratio
from tidewatch.operators.running import magnitude_slice


def cumulative(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row a distinct score: pos, neg, and tp, fp at that threshold (inclusive), n_pos, n_neg, and next_pos, next_neg of the next lower score."""
    known = scored.where(F.col("score").isNotNull() & F.col("y").isNotNull())
    g = known.groupBy(*keys, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    g = g.withColumn("c_slice", -magnitude_slice(F.col("score")))
    parts = g.groupBy(*keys, "c_slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"), F.max_by(F.struct("pos", "neg"), "score").alias("top"))
    order = Window.partitionBy(*keys).orderBy("c_slice")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        *keys, "c_slice", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"),
        F.sum("sp").over(whole).alias("n_pos"), F.sum("sn").over(whole).alias("n_neg"), F.lead("top").over(order).alias("after"),
    )
    w = Window.partitionBy(*keys, "c_slice").orderBy(F.col("score").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto), "nx": F.lead(F.struct("pos", "neg")).over(w)})
    g = g.join(parts, [*keys, "c_slice"])
    nx = F.coalesce("nx", "after")
    return g.select(*keys, "score", "pos", "neg", (F.col("tp") + F.col("bp")).alias("tp"), (F.col("fp") + F.col("bn")).alias("fp"), "n_pos", "n_neg", nx["pos"].alias("next_pos"), nx["neg"].alias("next_neg"))


def _areas() -> tuple[Column, Column]:
    """auroc and auprc as aggregates over ``cumulative`` rows."""
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    pairs = F.max(F.col("n_pos").cast("double") * F.col("n_neg"))
    ap = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return ratio(won, pairs).alias("auroc"), ratio(ap, F.max("n_pos")).alias("auprc")


def _on_curve() -> Column:
    """Whether a ``cumulative`` row is a point of the ROC curve: the first and the last, and those that do not lie on a line with both neighbours."""
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))


def areas(scored: DataFrame, keys: list[str]) -> DataFrame:
    """auroc (ties count half; null with one class) and auprc (average precision: step sum; null without positives)."""
    return cumulative(scored, keys).groupBy(*keys).agg(*_areas())


def roc_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """fpr, tpr, threshold: the row (0, 0, inf), then each distinct score that does not lie on a line with both neighbours. With no negatives fpr is null, with no positives tpr."""
    c = cumulative(scored, keys)
    points = c.where(_on_curve()).select(*keys, ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"), F.col("score").cast("double").alias("threshold"))
    zero = c.groupBy(*keys).agg(F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    zero = zero.select(*keys, F.when(F.col("n") > 0, 0.0).alias("fpr"), F.when(F.col("p") > 0, 0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.unionByName(zero)


def pr_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """recall, precision, threshold for every distinct score, and the end row (0, 1, null). Recall is null without positives."""
    c = cumulative(scored, keys)
    points = c.select(*keys, ratio(F.col("tp"), F.col("n_pos")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.col("score").cast("double").alias("threshold"))
    end = c.select(*keys).distinct().select(*keys, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def youden(curve: DataFrame, keys: list[str]) -> DataFrame:
    """best_threshold, best_tpr, best_fpr: the first point of a ROC curve with the largest tpr - fpr; with one class only, the leading row."""
    j = F.coalesce(F.col("tpr") - F.col("fpr"), F.lit(-2.0))
    best = curve.groupBy(*keys).agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(j.alias("j"), F.col("threshold"))).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("best_threshold"), F.col("b.tpr").alias("best_tpr"), F.col("b.fpr").alias("best_fpr"))


def alarms(scored: DataFrame, thresholds: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """``scored`` with alarm 0/1: score >= best_threshold, or > with ``strict``."""
    joined = scored.join(thresholds.select(*keys, "best_threshold"), keys)
    hit = F.col("score") > F.col("best_threshold") if strict else F.col("score") >= F.col("best_threshold")
    return joined.withColumn("alarm", hit.cast("int")).drop("best_threshold")


def confusion(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """tn, fp, fn, tp, precision, recall, f1; a zero denominator gives 0."""
    y, a = F.col("y"), F.col("alarm")
    return _rates(flagged.groupBy(*keys).agg(
        F.count_if((y == 0) & (a == 0)).alias("tn"), F.count_if((y == 0) & (a == 1)).alias("fp"), F.count_if((y == 1) & (a == 0)).alias("fn"), F.count_if((y == 1) & (a == 1)).alias("tp")
    ))


def _rates(counts: DataFrame) -> DataFrame:
    """``counts`` with precision, recall and f1."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return counts.withColumns({
        "precision": zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))), "recall": zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))),
        "f1": zero(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))),
    })


def anomaly_ratio(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys).agg(F.avg("y").alias("anomaly_ratio"))


def best_method(metrics: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The method with the strictly greatest auroc above 0, the first in ``order`` among equals; null if none is above 0."""
    keys = keys or []
    rank = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("method"))
    able = F.when(F.col("auroc") > 0, F.struct(F.col("auroc"), (-rank).alias("r")))
    return metrics.groupBy(*keys).agg(F.max_by("method", able).alias("best_method"), F.max(F.when(F.col("auroc") > 0, F.col("auroc"))).alias("best_auroc"))


def mean_metrics(summary: DataFrame, skip: bool = True) -> DataFrame:
    """mean_auroc, mean_auprc over all series; undefined values are skipped, or make the mean undefined."""

    def average(c: str):
        return F.avg(c) if skip else F.when(F.count("*") == F.count(c), F.avg(c))

    return summary.agg(average("auroc").alias("mean_auroc"), average("auprc").alias("mean_auprc"))


def trim_after_context(scores: DataFrame, context: int) -> DataFrame:
    """Steps from ``context`` on."""
    return scores.where(F.col("t") >= context)


def trim_full_windows(scores: DataFrame, context: int, horizon: int) -> DataFrame:
    """Steps from ``context`` to before n - horizon, n being the series' length in ``scores``."""
    n = scores.groupBy("series_id").agg((F.max("t") + 1).alias("tr_n"))
    return scores.join(n, "series_id").where((F.col("t") >= context) & (F.col("t") < F.col("tr_n") - horizon)).drop("tr_n")


def summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """auroc, auprc and Youden's point by group, from one pass over the running counts."""
    return _summary(scored, keys).drop("b", "p", "n")


def summary_with_confusion(scored: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """``summary`` and ``confusion`` of the ``alarms`` at its threshold. The running counts at Youden's point are those of the alarms, so the rows are not read again."""
    own = lambda name: F.lit(0) if not strict else F.col(f"b.{name}")
    tp, fp = (F.coalesce(F.col(f"b.{run}") - own(at), F.lit(0)).cast("long") for run, at in (("run_tp", "pos"), ("run_fp", "neg")))
    counted = _summary(scored, keys).withColumns({"tn": F.col("n") - fp, "fp": fp, "fn": F.col("p") - tp, "tp": tp})
    return _rates(counted.drop("b", "p", "n"))


def _summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``summary`` with the row of Youden's point (b; null where the leading row is best) and the counts of positives and negatives (p, n)."""
    tpr, fpr = ratio(F.col("tp"), F.col("n_pos")), ratio(F.col("fp"), F.col("n_neg"))
    # the leading row of the curve (0, 0, inf) wins ties with any other, and stands where there is one class only
    better = F.when(_on_curve() & (tpr - fpr > 0), F.struct((tpr - fpr).alias("j"), F.col("score").alias("s")))
    best = F.max_by(F.struct(F.col("score").cast("double").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), F.col("tp").alias("run_tp"), F.col("fp").alias("run_fp"), "pos", "neg"), better)
    out = cumulative(scored, keys).groupBy(*keys).agg(*_areas(), best.alias("b"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    return out.select(
        *keys, "auroc", "auprc", F.coalesce("b.threshold", F.lit(float("inf"))).alias("best_threshold"),
        F.coalesce("b.tpr", F.when(F.col("p") > 0, 0.0)).alias("best_tpr"), F.coalesce("b.fpr", F.when(F.col("n") > 0, 0.0)).alias("best_fpr"), "b", "p", "n",
    )
