"""Mixing sources to target weights, in DataFrame functions only.

Efraimidis-Spirakis sampling: each document gets the key ``-ln(u) / weight`` with u from a hash of
the document, so that the smallest keys are a weighted sample without replacement. Keys are sorted
within a source and sizes prefix-summed up to the source's token budget. Whole epochs come first:
a budget of 2.4 times the source takes every document twice and a 0.4 sample once more.

A source may hold a third of all rows, so no step gathers one: the key's range is cut into slices of
equal ratio, ``per_octave`` of them from a key to its double. Keys are exponential, so whatever the
weights, a slice holds at most 0.26 / ``per_octave`` of a source's rows. Sizes are summed by (source, slice), and only (source,
slice) groups are sorted. Equal rows have equal keys: a slice that they make larger than that is cut at their
key, and the rows of that key, which need no order, are dealt out by a number a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Most of a source's rows that keys put into a slice, times the slices of an octave.
DENSEST = 0.26
#: A slice of over HEAVY times that and HEAVY_ROWS more holds equal rows; a part of it has about HEAVY_ROWS or that share.
HEAVY, HEAVY_ROWS = 2, 10_000


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(mix_source, source_size) to (mix_source, source_size, target).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total of all sizes;
    none gets over ``cap`` times its size, and the excess goes to the others by weight. In order of
    cap by weight the capped sources come first, so one pass over the sources finds the level at
    which all others are filled. The windows below hold one row a source.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    s = sizes.withColumn("mix_weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("mix_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("mix_cap") / F.col("mix_weight")).asc(), F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    left = total - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))
    weight_left = F.sum("mix_weight").over(everything) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0.0))
    s = s.withColumn("mix_level", F.greatest(left, F.lit(0.0)) / weight_left)
    capped = F.col("mix_level") * F.col("mix_weight") >= F.col("mix_cap")
    level = F.max(F.when(~capped, F.col("mix_level"))).over(everything)
    return s.withColumn("mix_fill", level).select(
        "mix_source", "source_size", F.when(capped, F.col("mix_cap")).otherwise(F.col("mix_fill") * F.col("mix_weight")).alias("target")
    )


def _heavy_keys(rows: DataFrame, slices: DataFrame, per_octave: int, scratch: Scratch) -> DataFrame | None:
    """(mix_group, mix_slice, mix_cuts: the keys of many equal rows, in order, with the number of parts for each), or None if no slice is heavy."""
    share = F.floor(F.sum("slice_rows").over(Window.partitionBy("mix_group")) * F.lit(DENSEST / per_octave)) + F.lit(HEAVY_ROWS)
    heavy = slices.select("mix_group", "mix_slice", "slice_rows", share.alias("share")).where(F.col("slice_rows") > HEAVY * F.col("share"))
    heavy = scratch.write(heavy.select("mix_group", "mix_slice", "share"))
    if heavy.isEmpty():
        return None
    keys = rows.join(heavy, ["mix_group", "mix_slice"]).groupBy("mix_group", "mix_slice", "mix_key").agg(F.count("*").alias("n"), F.first("share").alias("share"))
    cut = F.struct(F.col("mix_key").alias("key"), F.ceil(F.col("n") / F.col("share")).alias("parts"))
    return scratch.write(keys.where("2 * n > share").groupBy("mix_group", "mix_slice").agg(F.sort_array(F.collect_list(cut)).alias("mix_cuts")))


def _cut_slices(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds mix_piece, which rises with the key within a slice and is odd for the key of many equal rows, and mix_part, by which those are dealt."""
    known = F.coalesce("mix_cuts", F.expr("cast(array() as array<struct<key: double, parts: bigint>>)"))
    below = F.size(F.filter(known, lambda c: c["key"] < F.col("mix_key")))
    parts = F.get(F.filter(known, lambda c: c["key"] == F.col("mix_key")), F.lit(0))["parts"]
    rows = rows.withColumn("mix_row", F.monotonically_increasing_id()).join(cuts, ["mix_group", "mix_slice"], "left")
    rows = rows.withColumns({"mix_piece": below * 2 + parts.isNotNull().cast("int"), "mix_part": F.coalesce(F.pmod("mix_row", parts), F.lit(0))})
    return rows.drop("mix_row", "mix_cuts")


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: DataFrame | None = None,
    with_row: bool = False,
    seed: int = 42,
    cap: float = 3.0,
    per_octave: int | None = None,
    whole: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, epochs, and with ``with_row`` the input row as the struct ``row``.

    ``taken`` counts words with repeats: size times the whole epochs, plus the document's part of
    the last, fractional epoch. At a budget's edge one document is taken in part, or, with
    ``whole``, in full if over half of it fits. ``weights`` has (doc_id, weight): quality weights of
    some documents, one row an id (no row, null or not positive: 1).

    Null text has size 0, null source is a source of its own after all others, null ids are
    ordinary ids. Repeated rows each count. Documents with equal keys are ordered by id, size and a
    hash of the text, so reruns agree; rows equal in all of these take their parts in any order, and many
    of them are split over tasks. Very long texts are counted whole. By default ``per_octave`` is such that no slice has many more than a million rows.
    An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    whole_row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_row else []
    rows = docs.select(
        F.col(doc_id).alias("mix_id"), F.col(source).alias("mix_source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mix_tie"), *whole_row,
    )
    scratch = scratch or Scratch(docs.sparkSession)
    if not with_row:
        rows = scratch.write(rows)
    if per_octave is None:
        per_octave = max(64, rows.count() // 4_000_000)
    if weights is None:
        rows = rows.withColumn("mix_quality", F.lit(1.0))
    else:
        by_id = weights.toDF("mix_weighed", "mix_weight")
        rows = rows.join(by_id, F.col("mix_id") == F.col("mix_weighed"), "left")
        rows = rows.withColumn("mix_quality", F.when(F.col("mix_weight") > 0, F.col("mix_weight").cast("double")).otherwise(F.lit(1.0))).drop("mix_weighed", "mix_weight")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "mix_tie"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("mix_key", -F.log(unit) / F.col("mix_quality"))
    # A null source cannot be a join key; the empty marker before every other name keeps them apart.
    rows = rows.withColumn("mix_group", F.coalesce(F.concat(F.lit("="), F.col("mix_source")), F.lit("")))
    rows = rows.withColumn("mix_slice", F.floor(F.log2(F.greatest("mix_key", F.lit(2.0**-60))) * per_octave).cast("int"))

    def by_slice(cell: list[str]) -> DataFrame:
        return scratch.write(rows.groupBy("mix_group", "mix_source", *cell).agg(F.sum("size").alias("slice_size"), F.count("*").alias("slice_rows")))

    cell = ["mix_slice"]
    slices = by_slice(cell)
    if (cuts := _heavy_keys(rows, slices, per_octave, scratch)) is not None:
        rows, cell = scratch.write(_cut_slices(rows, cuts)), ["mix_slice", "mix_piece", "mix_part"]
        slices = by_slice(cell)
    sums = slices.groupBy("mix_group", "mix_source").agg(F.sum("slice_size").alias("source_size"))
    plan = targets(sums.select("mix_source", "source_size"), cap)
    plan = plan.select(
        F.coalesce(F.concat(F.lit("="), F.col("mix_source")), F.lit("")).alias("mix_group"), "source_size", "target", F.round("target").cast("long").alias("mix_quota")
    )
    earlier = Window.partitionBy("mix_group").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("mix_before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).drop("mix_source", "slice_size", "slice_rows")
    slices = slices.join(plan, "mix_group")

    order = Window.partitionBy("mix_group", *cell).orderBy("mix_key", "mix_id", "size", "mix_tie")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    out = rows.withColumn("mix_within", within).join(slices, ["mix_group", *cell])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("mix_quota") / F.col("source_size"))).otherwise(0).cast("long")
    room = F.col("mix_quota") - epochs * F.col("source_size") - F.col("mix_before") - F.col("mix_within")
    part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    if whole:
        part = F.when(part * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = (epochs * F.col("size") + part).cast("long")
    return out.select(
        F.col("mix_id").alias(doc_id), "size", "source_size", "target", taken.alias("taken"), epochs.alias("epochs"), *(["row"] if with_row else [])
    )
