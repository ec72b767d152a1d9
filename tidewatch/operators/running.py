"""Running totals and positions of groups that may hold a large share of all rows.

A window over a group sorts it in one task. Here a group is cut into slices of its order column,
totals are summed by slice, and only slices are sorted; a slice's start comes from the totals of
those before it. The totals table has a row for each group and slice in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def magnitude_slice(x: Column, fineness: int = 64) -> Column:
    """A long that never falls as x rises: steps of about 1/fineness of x, on either side of 0."""
    size = F.least(F.greatest(F.log(F.abs(x)), F.lit(-700.0)), F.lit(700.0))
    step = F.floor(size * fineness) + 700 * fineness + 1
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * step).cast("long")


def position(df: DataFrame, keys: list[str], order: str, out: str = "t", slice_of: Column | None = None) -> DataFrame:
    """0-based position by ``order`` within ``keys``; equal order values get any order among themselves."""
    part = slice_of if slice_of is not None else day_slice(order)
    cut = df.withColumn("rt_slice", part)
    sizes = cut.groupBy(*keys, "rt_slice").agg(F.count("*").alias("rt_n"))
    before = Window.partitionBy(*keys).orderBy("rt_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("rt_before", F.coalesce(F.sum("rt_n").over(before), F.lit(0))).drop("rt_n")
    within = F.row_number().over(Window.partitionBy(*keys, "rt_slice").orderBy(order)) - 1
    return cut.withColumn("rt_within", within).join(sizes, [*keys, "rt_slice"]).withColumn(out, F.col("rt_before") + F.col("rt_within")).drop("rt_slice", "rt_within", "rt_before")


def day_slice(order: str) -> Column:
    return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / 86_400)


def previous(df: DataFrame, keys: list[str], order: str, out: str, slice_of: Column | None = None) -> DataFrame:
    """Adds the value of ``order`` in the row before, by ``order`` within ``keys``; null in the first row and where ``order`` is null.

    Only slices (days, by default) are sorted; a slice's first row takes the largest value of the slices before it, which
    comes from a table of one row a slice in use. So the day of a series is one task's sort, not the series.
    """
    cut = df.withColumn("rt_slice", day_slice(order) if slice_of is None else slice_of)
    ends = cut.where(F.col(order).isNotNull()).groupBy(*keys, "rt_slice").agg(F.max(order).alias("rt_end"))
    carried = F.lag("rt_end").over(Window.partitionBy(*keys).orderBy("rt_slice")).alias("rt_carried")
    ends = ends.select(*(F.col(k).alias(f"rt_key{i}") for i, k in enumerate(keys)), F.col("rt_slice").alias("rt_part"), carried)
    within = F.lag(order).over(Window.partitionBy(*keys, "rt_slice").orderBy(order))
    same = [F.col(k).eqNullSafe(F.col(f"rt_key{i}")) for i, k in enumerate(keys)] + [F.col("rt_slice") == F.col("rt_part")]
    joined = cut.withColumn("rt_within", within).join(ends, same, "left").select(*(F.col(f"`{c}`") for c in df.columns), "rt_within", "rt_carried")
    return joined.withColumn(out, F.coalesce("rt_within", "rt_carried")).drop("rt_within", "rt_carried")
