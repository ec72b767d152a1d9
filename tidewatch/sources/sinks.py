"""Result tables. Layouts are partitioned so that later reads open only what they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.naming import run_date, synthetic_time
from tidewatch.operators.windows import BLOCK

SCORE_LAYOUT = ("dataset", "context", "horizon", "method")
RESULTS = "file_name string, AUROC double, AUPRC double"


def write_csv_series(wide: DataFrame, path: str) -> None:
    """(series_id, split, t, one column a feature, optional label) as CSV, a folder ``file=<series>_<split>.csv`` each, with synthetic timestamps in place of t. Long series are several files."""
    named = wide.withColumns({"file": F.concat_ws("", "series_id", F.lit("_"), "split", F.lit(".csv")), "timestamp": synthetic_time(F.col("t")), "wc_block": F.floor(F.col("t") / BLOCK)})
    dealt = named.repartition("file", "wc_block").sortWithinPartitions("file", "t")
    dealt.select("timestamp", *(c for c in wide.columns if c not in ("series_id", "split", "t")), "file").write.option("header", True).partitionBy("file").csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Adds rows; a rerun adds them again. ``sources.commits`` has results that can be rerun and resumed."""
    df.write.mode("append").parquet(path)


def create_results(spark: SparkSession, path: str, schema: str = RESULTS) -> None:
    """An empty table, unless there is one."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """A ROC or PR curve, one folder a series. Rows are dealt by series, so that a folder gets one file and not one from each task; Spark splits a series that is too large for a task."""
    curve.hint("rebalance", "series_id").write.mode("overwrite").partitionBy("series_id").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """A score checkpoint by dataset, configuration and method."""
    scores.write.mode("overwrite").partitionBy(*SCORE_LAYOUT).parquet(path)


def write_window_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(path)


def write_method_metrics(metrics: DataFrame, path: str, dataset: str) -> None:
    """All methods' metrics with run date and dataset, in folders by both."""
    metrics.withColumns({"run_date": run_date(F.current_timestamp()), "dataset": F.lit(dataset)}).write.mode("append").partitionBy("run_date", "dataset").parquet(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report."""
    row.write.mode("overwrite").json(path)
