"""The corpus queries: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm.byte_dedup import remove_repeated_bytes
from tidewatch.llm.decontaminate import contaminated
from tidewatch.llm.html import extract_text
from tidewatch.llm.lexical import ranked_search
from tidewatch.llm.materialise import written_order
from tidewatch.llm.media import media_columns
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.periodic import periodic_runs, planted_loops
from tidewatch.llm.quality import importance_resample
from tidewatch.llm.shards import shuffle_into_shards
from tidewatch.llm.simhash import near_duplicate_groups
from tidewatch.llm.substring_dedup import remove_repeated_windows
from tidewatch.llm.tables import quality_weights, table
from tidewatch.llm.twins import OP3_SQL, OP4_SQL, OP11_SQL
from tidewatch.llm.urls import Rule, url_filter

#: Fixed values of the url contract.
URL_RULES = [
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20
), g AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM s
), r AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM g WHERE k > 1 GROUP BY doc_id
), o AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
    list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM o
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), with_media=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), ngram=3, radius=3)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mix_sources(docs, weights=quality_weights(labels))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_order(table(spark, sf_dir, "documents"), length=1024)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, similarity=0.8)


#: All windows of an item's word count that share a shingle with it, by exact weighted Jaccard similarity.
OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL
), known AS (
  SELECT DISTINCT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), t AS MATERIALIZED (
  SELECT row_number() OVER () AS item, item_id, ws, least(5, len(ws)) AS k FROM known WHERE len(ws) > 0
), b AS (
  SELECT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g, count(*) AS copies
  FROM (SELECT item, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM t) GROUP BY ALL
), s AS (
  SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM t))
), h AS MATERIALIZED (
  SELECT r, item, i, g, copies FROM s JOIN b USING (k, g)
), z AS (
  SELECT h.r, h.item, h.i, least(len(t.ws), len(d.ws)) - t.k + 1 AS m, greatest(len(d.ws) - len(t.ws), 0) + 1 AS last, len(t.ws) - t.k + 1 AS n
  FROM h JOIN d ON d.r = h.r JOIN t ON t.item = h.item
), w AS (
  SELECT DISTINCT r, item, m, n, unnest(range(greatest(1, i - m + 1), least(i, last) + 1)) AS a FROM z
), c AS (
  SELECT w.r, w.item, a, m, n, least(count(*), copies) AS common
  FROM w JOIN h ON h.r = w.r AND h.item = w.item AND h.i BETWEEN a AND a + m - 1 GROUP BY w.r, w.item, a, m, n, g, copies
), v AS (
  SELECT r, item, a, CAST(sum(common) AS DOUBLE) / CAST(m + n - sum(common) AS DOUBLE) AS value FROM c GROUP BY r, item, a, m, n
)
SELECT any_value(d.doc_id) AS doc_id, t.item_id, max(value) AS similarity, CAST(first(a ORDER BY value DESC, a) - 1 AS INTEGER) AS start
FROM v JOIN d ON d.r = v.r JOIN t ON t.item = v.item WHERE value >= 0.8 GROUP BY d.r, t.item_id
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Strings of 400 bytes are compared by MD5; a text is cut into blocks first, as DuckDB finds a place in a string by counting from its start.
OP8_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT r, base, least(400, length(h) // 2 - 399 - base) AS many, substr(h, 2 * base + 1, 1598) AS part
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399, 400)) AS base FROM d)
), s AS (
  SELECT r, base + j AS i, md5_number(substr(part, 2 * j + 1, 800)) AS string FROM (SELECT r, base, part, unnest(range(0, many)) AS j FROM b)
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY string) AS k FROM s
), n AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM g WHERE k > 1
), m AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM n
), p AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM m GROUP BY r, span
), c AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS cut FROM p
), q AS (
  SELECT r, count(*) AS spans, sum(hi - lo) AS gone, max(hi) AS last,
    string_agg(substr(h, 2 * cut + 1, 2 * (lo - cut)), '' ORDER BY lo) AS kept
  FROM c JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN q USING (r)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(table(spark, sf_dir, "documents"), 24)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted_loops(table(spark, sf_dir, "documents")), least=6, repeats=4)
    ranked = F.transform("runs", lambda r: F.struct((r.length / r.period).alias("exponent"), (-r.start).alias("start"), (-r.period).alias("period"), r.length.alias("length")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("best")
    return out.withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best.start).alias("start"),
        best.length.alias("length"),
        (-best.period).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


#: Every document's score for every item that shares a term with it.
OP12_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT r, doc_id, unnest(ts) AS term FROM (
    SELECT row_number() OVER () AS r, doc_id,
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents WHERE text IS NOT NULL)
), q AS (
  SELECT i, item_id, term, count(*) AS repeats FROM (
    SELECT i, item_id, unnest(ts) AS term FROM (
      SELECT row_number() OVER () AS i, item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL
), c AS MATERIALIZED (
  SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (
  SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY r
), a AS (
  SELECT count(*) AS many, CAST(sum(n) AS BIGINT) AS l FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * many + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), a
), s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * many) // l)))) AS BIGINT) AS score
  FROM q JOIN c USING (term) JOIN w USING (term) JOIN n USING (r), a GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: What the tables' pages come to, as each keeps its main text in one article of paragraphs and headings, which the query does not rely on.
OP13_SQL = r"""
WITH b AS (
  SELECT row_number() OVER () AS r, page_id, url, string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1|h2|h3|li|ul)>') AS blocks FROM pages
), p AS (
  SELECT r, i, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS line
  FROM (SELECT r, unnest(range(len(blocks))) AS i, unnest(blocks) AS block FROM b)
), t AS (
  SELECT r, string_agg(regexp_replace(line, '&amp$', '&'), chr(10) ORDER BY i) AS text FROM p WHERE line <> '' GROUP BY r
)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM b LEFT JOIN t USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_media_columns": op2_media_columns,
        "op3_simhash": op3_simhash,
        "op4_mixing": op4_mixing,
        "op5_token_output": op5_token_output,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_sharding": op9_sharding,
        "op10_url_filter": op10_url_filter,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_lexical_search": op12_lexical_search,
        "op13_html_text": op13_html_text,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_simhash": OP3_SQL, "op4_mixing": OP4_SQL, "op6_decontaminate": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_html_text": OP13_SQL}
