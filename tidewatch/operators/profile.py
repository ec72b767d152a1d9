"""Profiles of features and of collections of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.prep import KEY


def drift(points: DataFrame) -> DataFrame:
    """train_std, test_std (population) and drift, the distance of the two means, by feature."""
    v = lambda s: F.when(F.col("split") == s, F.col("value"))
    return points.groupBy(*KEY).agg(F.stddev_pop(v("train")).alias("train_std"), F.stddev_pop(v("test")).alias("test_std"), F.abs(F.avg(v("train")) - F.avg(v("test"))).alias("drift"))


def histogram(points: DataFrame, bins: int = 30) -> DataFrame:
    """Counts by bin 1..bins of each feature and split over its own range; the maximum is in the last bin, a constant feature in the first."""
    keys = [*KEY, "split"]
    span = points.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins) + 1
    found = points.where("value is not null").join(span, keys).withColumn("bin", F.least(at, F.lit(bins)).cast("int"))
    return found.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def preview(points: DataFrame, steps: int = 5, features: int = 10) -> DataFrame:
    """The first ``steps`` steps of the first ``features`` features, by name, of each series."""
    names = points.select(*KEY).distinct().withColumn("pv_rank", F.row_number().over(Window.partitionBy("series_id").orderBy("feature"))).where(F.col("pv_rank") <= features)
    return points.where(F.col("t") < steps).join(names.drop("pv_rank"), KEY, "left_semi")


def report(points: DataFrame, labels: DataFrame, least: float = 1e-8) -> DataFrame:
    """Quality and drift by feature, over train and test: share missing, drift, shared range, mean test value of normal and of anomalous steps, and whether the feature is kept (it has train values, and they vary)."""
    y = labels.where("split = 'test'").select("series_id", "split", "t", "y")
    v = F.col("value")
    labelled = points.join(y, ["series_id", "split", "t"], "left")
    out = labelled.groupBy(*KEY).agg(
        (1 - F.count(v) / F.count("*")).alias("missing"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.avg(F.when(F.col("y") == 0, v)).alias("mean_normal"), F.avg(F.when(F.col("y") == 1, v)).alias("mean_anomalous"),
    )
    return out.join(drift(points), KEY).withColumn("kept", F.coalesce(F.col("train_std") > least, F.lit(False)))


def shared_range(points: DataFrame) -> DataFrame:
    """Minimum and maximum by feature over both splits."""
    return points.groupBy(*KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def collection(points: DataFrame) -> DataFrame:
    """One row: n_series, shortest, longest, mean_length, fewest_features, most_features."""
    each = points.groupBy("series_id").agg(F.count_distinct("t").alias("length"), F.count_distinct("feature").alias("features"))
    return each.agg(
        F.count("*").alias("n_series"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"),
        F.min("features").alias("fewest_features"), F.max("features").alias("most_features"),
    )


def feature_sets(points: DataFrame) -> DataFrame:
    """One row a feature: n_series that have it, and common (all have it). The rows are the union, the common ones the intersection."""
    n = points.select("series_id").distinct().agg(F.count("*").alias("all_series"))
    own = points.select(*KEY).distinct().groupBy("feature").agg(F.count("*").alias("n_series"))
    return own.crossJoin(F.broadcast(n)).select("feature", "n_series", (F.col("n_series") == F.col("all_series")).alias("common"))  # one row


def removed_features(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select(*KEY).distinct().join(after.select(*KEY).distinct(), KEY, "left_anti")


def combine_series(frames: list[DataFrame]) -> DataFrame:
    """All rows of wide tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
