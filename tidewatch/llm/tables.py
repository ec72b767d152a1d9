"""The corpus tables, and row keys that nulls and repeated ids do not break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents: 0.5 for labels of quality 0, 2 for 1, the mean where an id has several."""
    return labels.groupBy("doc_id").agg((F.avg("quality") * 1.5 + 0.5).alias("weight"))


def id_key(doc_id: str = "doc_id") -> Column:
    """The id, null last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_rows(docs: DataFrame, decided: DataFrame, *, doc_id: str = "doc_id", text: str = "text", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is among the (doc_id, tag) of ``decided``, or with left_anti is not; all columns stay."""
    keys = decided.select(id_key("doc_id").alias("kr_id"), F.col("tag").alias("kr_tag"))
    keyed = docs.withColumns({"kr_row_id": id_key(doc_id), "kr_row_tag": text_key(text)})
    out = keyed.join(keys, (F.col("kr_row_id") == F.col("kr_id")) & (F.col("kr_row_tag") == F.col("kr_tag")), how)
    return out.drop("kr_row_id", "kr_row_tag")


def one_row_a_text(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of those with the same id (nulls are one) and the same text; texts that share an id all stay."""
    keyed = docs.withColumns({"kr_row_id": id_key(doc_id), "kr_row_tag": text_key(text)})
    order = Window.partitionBy("kr_row_id", "kr_row_tag").orderBy("kr_row_id")
    return keyed.withColumn("kr_rank", F.row_number().over(order)).where("kr_rank = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
