"""Tables in the folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset in a local session, as in tests."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession) -> str:
    """A new path in it; what is written there goes when the Python process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidewatch-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def parallel(spark: SparkSession) -> int:
    """How many tasks small rows are dealt over that grow into many; ``repartition`` by it is not coalesced."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once however often it is read, and safe from lost executors. It sets a session setting meanwhile: not for parallel callers of one session."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
