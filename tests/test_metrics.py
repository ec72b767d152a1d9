"""Metrics against plain versions and saved golden values."""

import math
import random

import pytest
from helpers import auroc, average_precision, moving_mean, roc

from tidewatch.operators import metrics
from tidewatch.operators.scoring import smooth

CASES = {
    "plain": ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]),
    "ties": ([0, 1, 0, 1, 1, 0], [0.5, 0.5, 0.5, 0.2, 0.9, 0.9]),
    "all_equal": ([0, 1, 1], [1.0, 1.0, 1.0]),
    "all_positive": ([1, 1], [0.3, 0.1]),
    "all_negative": ([0, 0], [0.3, 0.1]),
    "worse_than_chance": ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9]),
    "negative_scores": ([1, 0, 1, 0, 1], [-3.0, -0.5, 0.0, 2.5, 1e-9]),
}
rng = random.Random(1)
CASES["long"] = ([int(rng.random() < 0.2) for _ in range(800)], [round(rng.random() ** 3 * 10, 2) for _ in range(800)])


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(name, s, y) for name, (ys, ss) in CASES.items() for y, s in zip(ys, ss)]
    rows += [("plain", None, 1), ("plain", 0.2, None)]
    return spark.createDataFrame(rows, "series_id string, score double, y int").repartition(5)


def near(a, b):
    return a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_areas(scored):
    got = {r.series_id: r for r in metrics.areas(scored, ["series_id"]).collect()}
    for name, (y, s) in CASES.items():
        assert near(got[name].auroc, auroc(y, s)), name
        assert near(got[name].auprc, average_precision(y, s)), name
    assert got["all_positive"].auprc == 1.0


def test_roc_curve_and_best_point(scored):
    curve = metrics.roc_curve(scored, ["series_id"])
    rows = curve.collect()
    best = {r.series_id: r for r in metrics.youden(curve, ["series_id"]).collect()}
    for name, (y, s) in CASES.items():
        n, p = y.count(0), y.count(1)
        want = [(f / n if n else None, t / p if p else None, x) for f, t, x in roc(y, s)]
        got = sorted(((r.fpr, r.tpr, r.threshold) for r in rows if r.series_id == name), key=lambda r: -r[2])
        assert got == want, name
        if n and p:
            first = max(want, key=lambda r: r[1] - r[0])
            assert (best[name].best_threshold, best[name].best_tpr, best[name].best_fpr) == (first[2], first[1], first[0])
    assert best["worse_than_chance"].best_threshold == float("inf")
    assert (best["all_positive"].best_threshold, best["all_positive"].best_tpr, best["all_positive"].best_fpr) == (float("inf"), 0.0, None)


def test_pr_curve_ends_at_one(scored):
    rows = [r for r in metrics.pr_curve(scored, ["series_id"]).collect() if r.series_id == "ties"]
    assert sorted((r.recall, r.precision, r.threshold or 0) for r in rows) == [(0.0, 1.0, 0), (1 / 3, 0.5, 0.9), (2 / 3, 0.4, 0.5), (1.0, 0.5, 0.2)]


def test_confusion_strict_and_inclusive(spark):
    scored = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", 2.0, 1), ("a", 0.5, 1), ("b", 0.1, 0)], "series_id string, score double, y int")
    at = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "series_id string, best_threshold double")
    got = {r.series_id: r for r in metrics.confusion(metrics.alarms(scored, at, ["series_id"]), ["series_id"]).collect()}
    assert (got["a"].tn, got["a"].fp, got["a"].fn, got["a"].tp) == (0, 1, 1, 2)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, 0.0)
    strict = metrics.confusion(metrics.alarms(scored, at, ["series_id"], strict=True), ["series_id"]).where("series_id = 'a'").first()
    assert (strict.tn, strict.fp, strict.fn, strict.tp) == (1, 0, 2, 1)


def test_best_method_and_means(spark):
    m = spark.createDataFrame([("max", 0.7), ("l2", 0.7), ("mae", None), ("topk", 0.2)], "method string, auroc double")
    assert metrics.best_method(m, ["max", "topk", "l2", "mae"]).first().best_method == "max"
    assert metrics.best_method(m.where("method = 'mae'"), ["mae"]).first().best_method is None
    s = spark.createDataFrame([(0.5, 0.1), (None, 0.3)], "auroc double, auprc double")
    assert metrics.mean_metrics(s).first().mean_auroc == 0.5
    assert metrics.mean_metrics(s, skip=False).first().mean_auroc is None
    assert math.isclose(metrics.mean_metrics(s, skip=False).first().mean_auprc, 0.2)


def test_auroc_symmetry(spark):
    y, s = CASES["long"]
    df = spark.createDataFrame([("p", float(x), v) for v, x in zip(y, s)] + [("n", -float(x), v) for v, x in zip(y, s)] + [("m", math.exp(x), v) for v, x in zip(y, s)], "series_id string, score double, y int")
    got = {r.series_id: r.auroc for r in metrics.areas(df, ["series_id"]).collect()}
    assert math.isclose(got["p"] + got["n"], 1) and math.isclose(got["p"], got["m"])


#: Excerpt of a saved curve: the first points of a published ROC curve, kept though they lie on a line.
GOLDEN_START = [(0.0, 0.0, float("inf")), (0.0005896226415094339, 0.0, 9.84381861773415), (0.0011792452830188679, 0.0, 9.841750557800877), (0.0011792452830188679, 0.00641025641025641, 6.053440269257841)]


def test_leading_row_is_added_after_the_drop(spark):
    rows = [("g", 9.84381861773415, 0), ("g", 9.841750557800877, 0), ("g", 6.053440269257841, 1)] + [("g", 1.0, 0)] * 1694 + [("g", 1.0, 1)] * 155
    got = sorted(metrics.roc_curve(spark.createDataFrame(rows, "series_id string, score double, y int"), ["series_id"]).collect(), key=lambda r: -r.threshold)
    assert [(r.fpr, r.tpr, r.threshold) for r in got][:4] == GOLDEN_START


@pytest.mark.parametrize("size", [1, 2, 4, 5, 7])
def test_smoothing_reflects_edges(spark, size):
    series = {"five": [1.0, 4.0, 2.0, 8.0, 5.0], "flat": [3.0] * 6, "long": [float(i * i % 17) for i in range(40)]}
    df = spark.createDataFrame([(k, t, x) for k, v in series.items() for t, x in enumerate(v)], "series_id string, t long, score double")
    for block in (1 << 15, 8):
        got = smooth(df, "score", size, block=block).collect()
        for k, v in series.items():
            out = [r.score for r in sorted((r for r in got if r.series_id == k), key=lambda r: r.t)]
            assert all(math.isclose(a, b) for a, b in zip(out, moving_mean(v, size), strict=True))
