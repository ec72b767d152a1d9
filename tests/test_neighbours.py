"""Neighbours across slices against a window over whole series."""

import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.running import previous
from tidewatch.operators.windows import grid_check


def stamps(spark, seed=1):
    """Days with many rows, with one, with none; equal stamps; a null stamp; null and repeated keys."""
    rng = random.Random(seed)
    start, rows = datetime.datetime(2024, 1, 1), []
    for key in ("a", "b", None):
        for _ in range(120):
            day = rng.choice([0, 0, 0, 1, 5, 6, 40])
            rows.append((key, start + datetime.timedelta(days=day, seconds=rng.randrange(0, 86_400, 3600)), rng.randrange(9)))
    rows += [("one", start, 1), ("c", None, 1), ("c", start, 2)]
    rows += [("even", start + datetime.timedelta(hours=12 * i), i) for i in range(9)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int").repartition(4)


def test_previous_equals_lag(spark):
    df = stamps(spark)
    got = previous(df, ["k"], "ts", "before").where("ts IS NOT NULL")
    want = df.where("ts IS NOT NULL").withColumn("before", F.lag("ts").over(Window.partitionBy("k").orderBy("ts")))
    key = lambda d: sorted(map(str, d.groupBy("k", "ts", "before").count().collect()))
    assert key(got) == key(want)
    assert previous(df, ["k"], "ts", "before").columns == ["k", "ts", "v", "before"]
    assert previous(df, ["k"], "ts", "before").count() == df.count()


def test_grid_check_equals_a_whole_sort(spark):
    df = stamps(spark, 2).where("ts IS NOT NULL")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(Window.partitionBy("k").orderBy("ts")).cast("timestamp"))
    want = df.withColumn("gap", gap).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("gap").alias("n_steps"))
    got = grid_check(df, ["k"], "ts")
    assert sorted(map(str, got.select("k", "n", "n_steps").collect())) == sorted(map(str, want.collect()))
    assert {r.k for r in got.where("regular").collect()} == {"one", "c", "even"} and got.where("NOT rising").count() == 0


def test_no_window_sorts_a_whole_series(spark):
    plan = previous(stamps(spark), ["k"], "ts", "before")._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.split("\n") if "lag(ts" in x]
    assert lines and all("rt_slice" in x.split("windowspecdefinition(")[1] for x in lines)
