"""Cleaning, splitting and scaling of long series tables.

A long table has series_id, split ('train' or 'test'), t, feature, value. Fitted statistics come
from the train split only and are joined back by (series_id, feature); the statistics have one row
a feature, and Spark chooses the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["series_id", "feature"]
SENTINEL = -1.0


def clean(value: Column, sentinel: float = SENTINEL) -> Column:
    """NaN and the sentinel as null."""
    return F.nullif(F.nanvl(value, F.lit(None).cast("double")), F.lit(sentinel))


def clean_missing(points: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    return points.withColumn("value", clean(F.col("value"), sentinel))


def to_long(wide: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """One row a feature; by default every column but the ids, the timestamp and the label."""
    names = features or feature_columns(wide, ids)
    return wide.select(*ids, *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot(ids, [F.col(f"`{c}`") for c in names], "feature", "value")


def feature_columns(wide: DataFrame, ids: list[str], reserved: tuple[str, ...] = ("timestamp", "is_anomaly")) -> list[str]:
    return [c for c in wide.columns if c not in reserved and c not in ids]


def to_wide(points: DataFrame, ids: list[str], features: list[str], value: str = "value") -> DataFrame:
    """One column a feature, for output only."""
    return points.groupBy(*ids).pivot("feature", features).agg(F.first(value))


def features_and_labels(wide: DataFrame, ids: list[str], label: str = "is_anomaly", require: bool = False) -> tuple[DataFrame, DataFrame]:
    """(long features, labels); a missing label column gives null labels, or ValueError with ``require``."""
    if label not in wide.columns and require:
        raise ValueError(f"no label column {label!r}")
    y = F.col(label).cast("int") if label in wide.columns else F.lit(None).cast("int")
    return to_long(wide, ids), wide.select(*ids, y.alias("is_anomaly"))


def split_by_position(points: DataFrame, share: float = 0.2, length: str | None = None) -> DataFrame:
    """Steps before floor(n * share) of each series are train; test steps count from 0 again. ``length`` names a column that holds n, which saves finding it."""
    if length:
        joined = points.withColumnRenamed(length, "sp_n")
    else:
        joined = points.join(points.groupBy("series_id").agg((F.max("t") + 1).alias("sp_n")), "series_id")
    edge = F.floor(F.col("sp_n") * F.lit(share))
    train = F.col("t") < edge
    return joined.withColumns({"split": F.when(train, "train").otherwise("test"), "t": F.when(train, F.col("t")).otherwise(F.col("t") - edge).cast("long")}).drop("sp_n")


def _train(points: DataFrame) -> DataFrame:
    return points.where("split = 'train'")


def drop_empty_features(points: DataFrame) -> DataFrame:
    """Without the features that have no value in their series' train split."""
    seen = _train(points).groupBy(*KEY).agg(F.count("value").alias("n")).where("n > 0").select(*KEY)
    return points.join(seen, KEY, "left_semi")


def drop_flat_features(points: DataFrame, least: float = 1e-8) -> DataFrame:
    """Without the features whose train values hardly vary."""
    moving = _train(points).groupBy(*KEY).agg(F.stddev_pop("value").alias("sd")).where(F.col("sd") > least).select(*KEY)
    return points.join(moving, KEY, "left_semi")


def medians(points: DataFrame, exact: bool = True) -> DataFrame:
    """Train median by feature. ``exact`` keeps a count for each distinct value; else a sketch."""
    value = F.median("value") if exact else F.percentile_approx("value", 0.5, 10_000)
    return _train(points).groupBy(*KEY).agg(value.alias("med"))


def impute(points: DataFrame, exact: bool = True, fit: DataFrame | None = None) -> DataFrame:
    """Missing values by the train median, or the ``med`` of a stored ``fit`` (``operators.stored.fits``); features without one are dropped."""
    med = (medians(points, exact) if fit is None else fit.select(*KEY, "med")).where("med is not null")
    return points.join(med, KEY).withColumn("value", F.coalesce("value", "med")).drop("med")


def zscore(points: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """By train mean and population deviation, or those of a stored ``fit``; a zero deviation counts as 1."""
    fit = fit.select(*KEY, "mu", "sd") if fit is not None else _train(points).groupBy(*KEY).agg(F.avg("value").alias("mu"), F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("sd"))
    return points.join(fit, KEY).withColumn("value", (F.col("value") - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def filled_fit(points: DataFrame, exact: bool = True) -> DataFrame:
    """med, mu and sd by feature: the train median, and mean and population deviation (a zero counts as 1) of the train values once gaps are filled with it. Features without a train value have no row.

    One pass gives what ``drop_empty_features``, ``impute`` and ``zscore`` find one after the other: the gaps are a second part, of equal values, whose moments are added to those of the values.
    """
    v = F.col("value")
    med = F.median(v) if exact else F.percentile_approx(v, 0.5, 10_000)
    fit = _train(points).groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count(v).alias("k"), med.alias("med"), F.avg(v).alias("m"), F.var_pop(v).alias("var"), F.min(v).alias("lo"), F.max(v).alias("hi")
    ).where("k > 0")
    n, k, away = F.col("n"), F.col("k"), F.col("med") - F.col("m")
    # equal values have no deviation, whatever rounding the mean has
    sd = F.when(F.col("lo") < F.col("hi"), F.sqrt((k * F.col("var") + away * away * k * (n - k) / n) / n))
    return fit.select(*KEY, "med", (F.col("m") + away * (n - k) / n).alias("mu"), F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0)).alias("sd"))


def minmax(points: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """By train minimum and range, or those of a stored ``fit``; a zero range counts as 1."""
    fit = fit.select(*KEY, "lo", "hi") if fit is not None else _train(points).groupBy(*KEY).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    return points.join(fit, KEY).withColumn("value", (F.col("value") - F.col("lo")) / width).drop("lo", "hi")
