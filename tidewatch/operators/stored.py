"""Fitted statistics that are kept and merged: moments and a quantile sketch by series and feature.

Statistics of new files are made from those files alone and stored as a part beside the earlier ones; merging the
parts gives those of all files. Moments merge exactly (Chan's update of mean and sum of squares), least and largest too;
quantiles come from a KLL sketch, whose rank error depends on its size alone and does not grow with merging.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.prep import KEY

PART = "part_id"
SKETCH_SIZE = 2048
COLUMNS = "n long, mean double, m2 double, lo double, hi double, sketch binary"


def rank_error(size: int = SKETCH_SIZE) -> float:
    """By how much a quantile's rank is off, as a share of all values, with a probability of 99 %: the published fit for KLL sketches."""
    return 2.296 / size**0.9021


def fit_statistics(points: DataFrame, size: int = SKETCH_SIZE, split: str | None = "train") -> DataFrame:
    """(series_id, feature, n, mean, m2, lo, hi, sketch) of the values that are not null; ``m2`` is the sum of squares about the mean."""
    used = points.where("value IS NOT NULL" if split is None else F.col("value").isNotNull() & (F.col("split") == split))
    value = F.col("value")
    return used.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("m2"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.kll_sketch_agg_double(value, size).alias("sketch")
    )


def _chan(a: Column, b: Column) -> Column:
    n, gap = a.n + b.n, b.mean - a.mean
    return F.struct(n.alias("n"), (a.mean + gap * b.n / n).alias("mean"), (a.m2 + b.m2 + gap * gap * a.n * b.n / n).alias("m2"))


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """The statistics of all values of the parts; a key has one row in each part at most that it is in."""
    every = reduce(DataFrame.unionByName, parts)
    # one struct a part, in order of their values so that any order of the parts gives the same
    moments = F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))
    one = every.groupBy(*KEY).agg(moments.alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch").alias("sketch"))
    folded = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), _chan)
    return one.withColumn("m", folded).select(*KEY, "m.n", "m.mean", "m.m2", "lo", "hi", "sketch")


def store_statistics(stats: DataFrame, path: str, part: str) -> None:
    """As the part of that name, in place of an earlier one; other parts are not read."""
    stats.withColumn(PART, F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def stored_statistics(spark: SparkSession, path: str, series_type: str = "string") -> DataFrame:
    """The statistics of all stored parts together."""
    parts = spark.read.schema(f"series_id {series_type}, feature string, {COLUMNS}, {PART} string").parquet(path)
    return merge_statistics(parts.drop(PART))


def fits(stats: DataFrame) -> DataFrame:
    """What cleaning and scaling join to their rows: med, mu, sd (1 where values do not vary), lo, hi, and p01 and p99."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return stats.select(*KEY, at(0.5).alias("med"), F.col("mean").alias("mu"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd"), "lo", "hi", at(0.01).alias("p01"), at(0.99).alias("p99"))
