"""Series as long tables: from CSV directories, and from event, order and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.arrays import rounded_to
from tidewatch.functions.naming import series_of, split_of
from tidewatch.operators.prep import to_long
from tidewatch.operators.running import position
from tidewatch.sources.headers import read_by_header
from tidewatch.sources.shared import cut, parallel


def read_csv_series(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, glob: str = "*.csv", exclude: tuple[str, ...] = (), default_split: str = "test"
) -> DataFrame:
    """All matching files of a directory: series_id and split from the file's name (or its folder's, if that ends in .csv), t from the timestamp order, and the columns of ``schema``.

    Each file's columns are found by its own header (``sources.headers``), so files may have them in any order,
    lack some, or have more. Without a schema the columns are the union of all headers. Without a timestamp
    column, or where a file lacks it, the order is that of the lines, by ascending file block and line.
    Files are parsed once: what is read is written as a table, from which positions are found.
    """
    raw = cut(read_by_header(spark, path, schema, glob))
    df = raw.withColumns({"series_id": series_of(F.col("sr_file")), "split": split_of(F.col("sr_file"), default_split)}).drop("sr_file")
    df = df.where(~F.col("series_id").isin(*exclude)) if exclude else df
    time = _seconds(df, "timestamp") if "timestamp" in df.columns else F.lit(None).cast("double")
    ordered = df.withColumn("sr_time", time).withColumn("sr_order", F.struct("sr_time", "sr_at", "sr_line"))
    # lines without a time come first; their slices are those of the file
    slices = F.struct(F.floor(F.col("sr_time") / 86_400), F.when(F.col("sr_time").isNull(), F.col("sr_at")))
    return position(ordered, ["series_id", "split"], "sr_order", slice_of=slices).drop("sr_at", "sr_line", "sr_time", "sr_order")


def _seconds(df: DataFrame, name: str) -> Column:
    """A timestamp as seconds: numbers as they are, whether typed or text."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return F.coalesce(c.try_cast("double"), F.unix_micros(c.try_cast("timestamp")) / 1e6) if kind == "string" else c.cast("double")


def csv_points(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, **options) -> DataFrame:
    """``read_csv_series`` as long points."""
    return to_long(read_csv_series(spark, path, schema, **options), ["series_id", "split", "t"])


#: Steps of a block of the grid.
GRID = 512


def _gridded(rows: DataFrame, keys: list[str], value: Column, length: str | None = None) -> DataFrame:
    """``keys``, t and value: every step 0..n-1 of every group of ``keys``, n being one more than the last step of its series; value is null where a step has no rows. ``length`` names a column for n.

    Steps are made from blocks of up to ``GRID`` of them, dealt over a number of tasks that is set: blocks are so
    small that Spark would coalesce those of a large table into one task, which would then make all steps.
    """
    block, tasks = F.floor(F.col("t") / GRID), parallel(rows.sparkSession)
    cells = rows.groupBy(*keys, "t").agg(value.alias("value")).withColumn("g_block", block)
    found = cells.repartition(tasks, *keys, "g_block").groupBy(*keys, "g_block").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("g_cells"))
    lengths = rows.groupBy(*keys).agg((F.max("t") + 1).alias("g_n")).withColumn("g_n", F.max("g_n").over(Window.partitionBy("series_id"))).where("series_id is not null")
    blocks = lengths.withColumn("g_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("g_n") - 1) / GRID))))
    both = blocks.repartition(tasks, *keys, "g_block").join(found, [*keys, "g_block"], "left")
    # a cell and the steps without one after it are one piece; the first piece begins with the block
    ends = F.col("g_block") * GRID, F.least((F.col("g_block") + 1) * GRID, F.col("g_n"))
    first, last = (F.array(F.struct(t.alias("t"), F.lit(None).cast("double").alias("value"))) for t in ends)
    some = F.coalesce("g_cells", F.array().cast(found.schema["g_cells"].dataType))
    kept = [*keys, *([F.col("g_n").alias(length)] if length else [])]
    pieces = both.select(*keys, "g_n", F.inline(F.arrays_zip(F.concat(first, some).alias("c"), F.concat(some, last).alias("d"))).alias("g_c", "g_d"))
    pieces = pieces.where(F.col("g_c.t") < F.col("g_d.t")).select(*keys, "g_n", F.col("g_c.t").alias("g_from"), F.col("g_c.value").alias("g_value"), F.col("g_d.t").alias("g_to"))
    out = pieces.withColumn("t", F.explode(F.sequence("g_from", F.col("g_to") - 1)))
    return out.select(*kept, "t", F.when(F.col("t") == F.col("g_from"), F.col("g_value")).alias("value"))


def day_zero(df: DataFrame, ts: str) -> Column:
    """Midnight of the first day of ``ts`` in the table, so that no row comes before step 0."""
    return F.lit(df.agg(F.date_format(F.min(ts), "yyyy-MM-dd")).first()[0]).cast("timestamp_ntz")


def _event_cells(events: DataFrame, users: int) -> DataFrame:
    """Series, hour and event; a series is ``users`` neighbouring users, so that series grow in number with the table and not in density."""
    t = F.timestamp_diff("HOUR", day_zero(events, "ts"), F.col("ts")).cast("long")
    return events.select(F.concat(F.lit("s"), F.floor(F.col("user_id") / users).cast("string")).alias("series_id"), t.alias("t"), "event_type", "value")


def event_points(events: DataFrame, users: int = 25, missing_every: int = 17, length: str | None = None) -> DataFrame:
    """Hourly mean value by event type. By a fixed rule one cell in ``missing_every`` holds the sentinel -1. ``length`` names a column for the number of the series' hours."""
    rows = _event_cells(events, users).withColumnRenamed("event_type", "feature")
    lost = (F.col("t") + F.length("feature")) % missing_every == 0
    return _gridded(rows, ["series_id", "feature"], rounded_to(F.avg("value"), 6), length).withColumn("value", F.when(lost, F.lit(-1.0)).otherwise(F.col("value")))


def event_labels(events: DataFrame, users: int = 25, above: float = 150.0, length: str | None = None) -> DataFrame:
    """y = 1 for hours whose largest value is over ``above``; every hour of a series has a row."""
    hours = _gridded(_event_cells(events, users), ["series_id"], F.max("value"), length)
    return hours.withColumn("y", (F.coalesce("value", F.lit(0.0)) > above).cast("int")).drop("value")


def line_points(lineitem: DataFrame) -> DataFrame:
    """Daily mean quantity by line status; series by return flag."""
    t = F.timestamp_diff("DAY", day_zero(lineitem, "l_shipdate"), F.col("l_shipdate")).cast("long")
    rows = lineitem.select(F.col("l_returnflag").alias("series_id"), t.alias("t"), F.col("l_linestatus").alias("feature"), "l_quantity")
    return _gridded(rows, ["series_id", "feature"], rounded_to(F.avg("l_quantity"), 6))


def order_points(orders: DataFrame) -> DataFrame:
    """Daily mean price by priority; one series."""
    t = F.timestamp_diff("DAY", day_zero(orders, "o_orderdate"), F.col("o_orderdate")).cast("long")
    rows = orders.select(F.lit("orders").alias("series_id"), t.alias("t"), F.col("o_orderpriority").alias("feature"), "o_totalprice")
    return _gridded(rows, ["series_id", "feature"], rounded_to(F.avg("o_totalprice"), 6))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score checkpoint; filters on dataset, context, horizon and method prune folders."""
    return spark.read.parquet(path)
