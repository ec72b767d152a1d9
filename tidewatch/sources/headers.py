"""CSV files of one directory whose columns differ, each read by its own header.

Spark gives columns by place and ignores headers where a schema is set. Here a first scan keeps one row a
file, its header. If all files have the same, Spark reads them with that order as the schema. Otherwise one
read takes all fields of all files as strings, and a join with the headers, by file, says at which place each
column stands.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from tidewatch.sources.shared import cut

FILE = "_metadata.file_path"


def header_names(line: str) -> list[str]:
    """Column names of a header line as pandas gives them: a repeated name gets .1, .2, ..., an empty one is named by its place."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name = name if name.strip() else f"Unnamed: {i}"
        many = seen.get(name, 0)
        seen[name] = many + 1
        fresh = name if not many else f"{name}.{many}"
        while many and fresh in out:
            many += 1
            fresh = f"{name}.{many}"
        out.append(fresh)
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["names"] = [header_names(line) for line in pdf.pop("line")]
        yield pdf


def headers(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """(hd_file, names): one row a file with a header, its first line that is not blank."""
    lines = spark.read.options(pathGlobFilter=glob, recursiveFileLookup=True).text(path).withColumn("hd_file", F.col(FILE)).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    # lines of a block ascend in one task, so the least number is the block's first line
    first = lines.withColumn("hd_line", F.monotonically_increasing_id()).groupBy("hd_file").agg(F.min_by("value", "hd_line").alias("line"))
    return first.mapInPandas(_parsed, "hd_file string, names array<string>")


def _typed(value: Column, kind: DataType) -> Column:
    """The field as ``kind``; null where it is empty or cannot be read so."""
    if isinstance(kind, StringType):
        return value
    text = F.trim(value)
    if kind.simpleString() in ("int", "bigint", "smallint", "tinyint"):
        # pandas writes whole numbers with a point where a column has gaps
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def read_by_header(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, glob: str = "*.csv") -> DataFrame:
    """The rows of all matching files of the directories and their subfolders, with the columns of ``schema`` by name, its file as sr_file, and sr_at and sr_line, by which the lines of a file ascend.

    A column that a file lacks is null in its rows; columns beyond the schema are left out. Without a schema the
    columns are all names of all headers in ascending order, ``timestamp`` as it stands and the others as numbers (``is_anomaly``: int).
    Fields that cannot be read as their type are null, and so are fields that a short row lacks. A directory
    without a header gives no rows.
    """
    found = cut(headers(spark, path, glob))  # one scan of the files, however often it is read
    known = found.groupBy("names").agg(F.count("*").alias("files")).select("names")
    kinds = [r.names for r in known.limit(2).collect()]
    if schema is None:
        names = [r[0] for r in known.select(F.explode("names")).distinct().orderBy("col").collect()]  # the columns of the result
        wanted = StructType([StructField(c, StructType.fromDDL(f"x {'string' if c == 'timestamp' else 'int' if c == 'is_anomaly' else 'double'}")[0].dataType) for c in names])
    else:
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # before any join, so that they follow the lines
    extra = {"sr_file": F.col(FILE), "sr_at": F.col("_metadata.file_block_start"), "sr_line": F.monotonically_increasing_id()}
    if len(kinds) <= 1:  # one header for all: Spark reads only the columns that are asked for
        (names,) = kinds or [[]]
        raw = spark.read.schema(StructType([StructField(f"c{i}", StringType()) for i in range(max(1, len(names)))]))
        rows = raw.options(header=True, pathGlobFilter=glob, recursiveFileLookup=True).csv(path).withColumns(extra)
        field = lambda c: F.col(f"c{names.index(c)}") if c in names else F.lit(None).cast("string")
    else:
        width = known.agg(F.max(F.size("names"))).first()[0]
        raw = spark.read.schema(StructType([StructField(f"c{i}", StringType()) for i in range(width)]))
        rows = raw.options(header=True, pathGlobFilter=glob, recursiveFileLookup=True).csv(path).withColumns(extra)
        place = found.select("hd_file", F.array(*(F.array_position("names", F.lit(f.name)) - 1 for f in wanted)).alias("hd_places"))
        rows = rows.withColumn("hd_fields", F.array(*(f"c{i}" for i in range(width)))).join(place, F.col("sr_file") == F.col("hd_file"))
        order = {f.name: i for i, f in enumerate(wanted)}
        field = lambda c: F.expr(f"if(hd_places[{order[c]}] < 0, null, get(hd_fields, int(hd_places[{order[c]}])))")
    return rows.select(*(_typed(field(f.name), f.dataType).alias(f.name) for f in wanted), *extra)
