"""A training corpus from raw documents: five stages, each a corpus operator applied to all that the one before kept.

Each stage but the last returns the columns of ``documents``; ``run`` applies them in order. Null
texts, null ids and repeated rows follow the operators' own rules; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.decontaminate import contaminated
from tidewatch.llm.materialise import training_order
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.quality import importance_resample
from tidewatch.llm.scratch import Scratch
from tidewatch.llm.similar import similar_groups
from tidewatch.llm.tables import keep_rows, one_row_a_text, quality_weights, table, text_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    scored = importance_resample(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, scored.where("kept").select("doc_id", "tag"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a similarity of 0.8): the one with the smallest id."""
    first = similar_groups(docs, ngram=5, similarity=0.8).select(F.col("first_id").alias("doc_id"), F.col("first_tag").alias("tag"))
    return one_row_a_text(keep_rows(docs, first.distinct()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    # the id alone is no key: it may be null, or other texts may share it
    keyed = docs.select(F.struct("doc_id", text_key().alias("tag")).alias("row"), "text")
    hit = contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id="row", shingle=5, similarity=0.8).select("row.doc_id", "row.tag")
    return keep_rows(docs, hit.distinct(), how="left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, once for each time that the mix takes them."""
    mixed = mix_sources(docs, weights=quality_weights(table(spark, sf_dir, "labels")), with_row=True, whole=True)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order."""
    return training_order(docs, length=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Hash n-grams, XXH64 fingerprints and a tokenizer are beyond DuckDB's SQL; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a written table."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
