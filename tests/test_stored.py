"""Stored statistics: parts merged against the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import prep, scoring
from tidewatch.operators.stored import fit_statistics, fits, merge_statistics, rank_error, store_statistics, stored_statistics


def series(spark, n=40_000, offset=0.0):
    """Two features of one long series with different spreads; the last tenth is test."""
    df = spark.range(n).select(
        F.lit("s").alias("series_id"), F.when(F.col("id") < n * 0.9, "train").otherwise("test").alias("split"), F.col("id").alias("t"),
        F.explode(F.array(F.struct(F.lit("a").alias("feature"), F.randn(3).alias("value")), F.struct(F.lit("b").alias("feature"), (F.pow(F.rand(4), 5) * 1000).alias("value")))).alias("p"),
    ).select("series_id", "split", "t", "p.feature", (F.col("p.value") + F.lit(offset)).alias("value"))
    rows = df.collect()
    return spark.createDataFrame(rows, df.schema), rows


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_merged_parts_are_within_the_stated_error(spark, tmp_path, offset):
    df, rows = series(spark, offset=offset)
    for i, part in enumerate((df.where("t < 9000"), df.where("t >= 9000 AND t < 9100"), df.where("t >= 9100"))):
        store_statistics(fit_statistics(part), str(tmp_path / "s"), f"file{i}")
    whole, merged = fits(fit_statistics(df)).collect(), {r.feature: r for r in fits(stored_statistics(spark, str(tmp_path / "s"))).collect()}
    for w in whole:
        m, v = merged[w.feature], np.array(sorted(r.value for r in rows if r.feature == w.feature and r.split == "train"))
        assert abs(m.mu - v.mean()) < 1e-9 * max(1, abs(offset)) and abs(m.sd / v.std() - 1) < 1e-9
        assert (m.lo, m.hi) == (v[0], v[-1])
        for p, found in ((0.5, m.med), (0.01, m.p01), (0.99, m.p99)):
            assert abs(np.searchsorted(v, found, side="right") / len(v) - p) <= rank_error()


def test_a_part_stored_again_replaces_itself(spark, tmp_path):
    df, _ = series(spark, 300)
    for part in ("x", "y", "x"):
        store_statistics(fit_statistics(df.where(f"t % 2 = {int(part == 'x')}")), str(tmp_path / "s"), part)
    got = {r.feature: r for r in stored_statistics(spark, str(tmp_path / "s")).collect()}
    assert all(r.n == 270 for r in got.values())


def test_order_of_parts_and_keys_in_one_part(spark):
    df, _ = series(spark, 300)
    parts = [fit_statistics(df.where("t < 50")), fit_statistics(df.where("t >= 50 AND feature = 'a'")), fit_statistics(df.where("t >= 50 AND feature = 'b'"))]
    one, other = merge_statistics(*parts), merge_statistics(*reversed(parts))
    key = lambda d: sorted((r.feature, r.n, r.mean, r.m2, r.lo, r.hi) for r in d.collect())
    assert key(one) == key(other)
    assert key(merge_statistics(fit_statistics(df.where("t < 0")), parts[0])) == key(parts[0])


def test_preparation_by_stored_fits(spark):
    """Up to a sketch's size quantiles are exact, so both ways agree but for the median of an even number."""
    df, _ = series(spark, 401)
    df = df.withColumn("value", F.when(F.col("t") % 7 != 3, F.col("value")))
    fit = fits(fit_statistics(df))
    pairs = [(prep.zscore(prep.impute(df, fit=fit), fit=fit), "zscore"), (prep.minmax(prep.impute(df, fit=fit), fit=fit), "minmax")]
    train = df.where("split = 'train' AND value IS NOT NULL")
    for got, kind in pairs:
        for f in ("a", "b"):
            v = np.array([r.value for r in train.where(F.col("feature") == f).collect()])
            med = np.sort(v)[int(np.ceil(len(v) / 2)) - 1]
            mine = {r.t: r.value for r in got.where(F.col("feature") == f).collect()}
            raw = {r.t: r.value for r in df.where(F.col("feature") == f).collect()}
            for t, x in raw.items():
                x = med if x is None else x
                want = (x - v.mean()) / v.std() if kind == "zscore" else (x - v.min()) / (v.max() - v.min())
                assert abs(mine[t] - want) < 1e-9
    scores = df.select("series_id", "feature", "t", F.col("value").alias("score"))
    clipped = scoring.robust_normalize(scores, fit=fit)
    assert clipped.agg(F.min("score"), F.max("score")).first()[:] == (0.0, 1.0)
