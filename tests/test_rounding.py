"""Rounding as the SQL twins do it, on values whose decimals end in a 5; curves with one file a series."""

import duckdb

from pyspark.sql import functions as F

from tidewatch.functions.arrays import rounded_to
from tidewatch.plans import registry
from tidewatch.sources import sinks


def test_halves_round_as_in_the_twins(spark):
    values = [0.621875, 41 / 640, 323 / 640, 333 / 640, 0.5, 0.0078125, -0.621875, -2.5, 0.0, float("nan"), None] + [p / 640 for p in range(640)] + [p / 320 for p in range(320)]
    db = duckdb.connect()
    db.execute("CREATE TABLE v (i INTEGER, x DOUBLE)")
    db.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(values)))
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (0, 3, 4, 5, 6):
        want = db.execute(f"SELECT i, {registry.r('x', digits)} FROM v ORDER BY i").fetchall()
        got = [tuple(row) for row in registry.rounded(df, "x", digits=digits).orderBy("i").collect()]
        assert repr(got) == repr(want)
    assert df.select(rounded_to(F.col("x"), 5).alias("x")).first().x == 0.62187


def test_a_series_curve_is_one_file(spark, tmp_path):
    curve = spark.range(4000).repartition(16).selectExpr("'s' || id % 5 AS series_id", "id / 4000 AS fpr", "id / 4000 AS tpr", "CAST(id AS DOUBLE) AS threshold")
    sinks.write_curve(curve, str(tmp_path / "c"))
    assert [len(list(p.glob("*.parquet"))) for p in sorted((tmp_path / "c").glob("series_id=*"))] == [1] * 5
    back = spark.read.parquet(str(tmp_path / "c")).select(*curve.columns)
    assert back.exceptAll(curve).count() == 0 and back.count() == 4000
