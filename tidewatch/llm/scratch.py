"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only in a local session where it is unset, as
in tests, a local temporary folder is used; elsewhere a missing setting is an error. A written table
cuts the lineage, survives lost executors, and lets Spark drop the shuffle files of the job that wrote it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-tidewatch-"))
        base = _local[0]
    return f"{base.rstrip('/')}/tidewatch"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call.

    ``write`` stores a DataFrame and returns it as read back. ``drop`` deletes tables that no later
    step reads. What the returned result still reads is deleted when the Python process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def place(self) -> str:
        """A path of its own in the shared folder, deleted when the process ends."""
        path = f"{folder(self.spark)}/{uuid.uuid4().hex}"
        atexit.register(_quiet_remove, self.spark, path)
        return path

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Writes in here drop their shuffle files when they are done. The setting is the session's: not for parallel callers of one session."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_CLEANUP, before)

    def write(self, df: DataFrame) -> DataFrame:
        path = self.place()
        with self.tidy():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if (path := self._paths.pop(id(t), None)) is not None:
                _remove(self.spark, path)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    """At exit: the session may be gone by then, and with it the way to delete."""
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001
        pass
