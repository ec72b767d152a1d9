"""Result tables that can be rerun and resumed.

Keys are worked on in waves. A wave's results are one commit: written to a folder of their own, and counted only
once a second table lists the wave's keys under that commit. A run that is cut off leaves at most one commit that
is not counted; the next run has the same keys left, so it writes the same commit again, in place of what is there.
Keys that are listed are never worked on again, and keys that come later make further commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COMMIT = "commit_id"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType([*schema, StructField(COMMIT, StringType())])
    return spark.read.schema(full).parquet(path) if _there(spark, path) else spark.createDataFrame([], full)


def _put(df: DataFrame, path: str, commit: str) -> None:
    """``df`` as one commit; what an earlier try left of it is replaced. Files are staged and moved when the job is done."""
    df.withColumn(COMMIT, F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(COMMIT).parquet(path)


def finished(spark: SparkSession, path: str, keys: StructType) -> DataFrame:
    """The keys whose results are committed, and their commits."""
    return _table(spark, f"{path}/keys", keys)


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The results of all commits that are counted; no others are opened."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    counted = [r[0] for r in finished(spark, path, StructType([])).select(COMMIT).distinct().collect()]  # one a wave and run with new keys
    return _table(spark, f"{path}/results", kind).where(F.col(COMMIT).isin(counted)).drop(COMMIT)


def run_in_waves(work: DataFrame, keys: list[str], path: str, compute: Callable[[DataFrame], DataFrame], waves: int = 8) -> list[str]:
    """``compute`` applied to the rows of ``work`` of all keys without committed results, in ``waves`` parts; the ids of the commits made.

    ``compute`` gives all results of the keys in its input, and none of others. A key without results counts as done.
    A wave is one job over many keys, so ``waves`` is how much a failure may cost, not how much runs at once. Runs of
    one path must follow each other. Nulls in keys are keys.
    """
    spark = work.sparkSession
    kinds = StructType([work.schema[k] for k in keys])
    made = []
    for wave in range(waves):
        done = finished(spark, path, kinds)
        mine = work.where(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave)
        names = {k: f"cm_{i}" for i, k in enumerate(keys)}
        listed = done.select(*(F.col(k).alias(n) for k, n in names.items()))
        rest = mine.join(listed, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left_anti")
        left = rest.select(*keys).distinct()
        if not left.head(1):
            continue
        commit = f"{wave}of{waves}_{done.where(F.col(COMMIT).startswith(f'{wave}of{waves}_')).select(COMMIT).distinct().count()}"
        _put(compute(rest), f"{path}/results", commit)
        _put(left, f"{path}/keys", commit)
        made.append(commit)
    return made
