"""Runs that are cut off and started again against runs that are not."""

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.commits import COMMIT, finished, read_committed, run_in_waves

SCHEMA = "k string, n long, total double"


def work(spark, names):
    rows = [(None if n == "null" else n, i, float(i * len(n))) for n in names for i in range(1 + len(n) % 4)]
    return spark.createDataFrame(rows, "k string, t long, v double")


class Compute:
    """Sums by key; fails at the given call, before or after its results are written."""

    def __init__(self, fail=None, late=False):
        self.calls, self.fail, self.late = 0, fail, late

    def __call__(self, rows):
        self.calls += 1
        out = rows.where("k IS NULL OR k <> 'nothing'").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        if self.calls == self.fail:
            if self.late:  # some tasks end, then one fails
                return out.withColumn("total", F.when(F.col("k") != "s7", F.col("total")).otherwise(F.raise_error(F.lit("lost")).cast("double")))
            raise InterruptedError
        return out


def rows(spark, path):
    return sorted(map(str, read_committed(spark, str(path), SCHEMA).collect()))


NAMES = [f"s{i}" for i in range(12)] + ["nothing", "null", "s7"]


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("fail", [1, 2, 3])
def test_a_run_cut_off_equals_one_that_is_not(spark, tmp_path, fail, late):
    df, whole = work(spark, NAMES), Compute()
    assert len(run_in_waves(df, ["k"], str(tmp_path / "whole"), whole, waves=3)) == whole.calls == 3
    broken = Compute(fail, late)
    try:
        run_in_waves(df, ["k"], str(tmp_path / "cut"), broken, waves=3)
    except Exception:  # noqa: BLE001
        made = broken.calls - 1
        again = Compute()
        assert len(run_in_waves(df, ["k"], str(tmp_path / "cut"), again, waves=3)) == again.calls == 3 - made
    assert rows(spark, tmp_path / "cut") == rows(spark, tmp_path / "whole")
    assert len(rows(spark, tmp_path / "cut")) == 13


def test_a_rerun_repeats_nothing_and_new_keys_are_added(spark, tmp_path):
    path, first, more = str(tmp_path / "x"), work(spark, NAMES), work(spark, [*NAMES, "new", "newer"])
    run_in_waves(first, ["k"], path, Compute(), waves=2)
    again = Compute()
    assert run_in_waves(first, ["k"], path, again, waves=2) == [] and again.calls == 0
    before = rows(spark, tmp_path / "x")
    made = run_in_waves(more, ["k"], path, Compute(), waves=2)
    assert 1 <= len(made) <= 2 and all(m.endswith("_1") for m in made)
    after = rows(spark, tmp_path / "x")
    assert set(before) <= set(after) and len(after) == len(before) + 2
    assert finished(spark, path, first.select("k").schema).count() == 16


def test_results_that_are_not_counted_are_not_read(spark, tmp_path):
    path = str(tmp_path / "x")
    run_in_waves(work(spark, NAMES), ["k"], path, Compute(), waves=1)
    before = rows(spark, path)
    spark.createDataFrame([("ghost", 1, 1.0, "0of1_9")], f"{SCHEMA}, {COMMIT} string").write.mode("append").partitionBy(COMMIT).parquet(f"{path}/results")
    assert rows(spark, path) == before
    assert read_committed(spark, str(tmp_path / "none"), SCHEMA).collect() == []
