"""URL filter: a rule list first, gradient-boosted trees on lexical features for the rest.

Features come from the url string alone, in SQL functions. The trees are Spark's own, fitted on a
bounded sample of labelled urls (``sample`` rows, the lowest by a hash of the url); everything is
scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return ascii_lower, path


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null if none); equal lengths: the first in code-point order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(verdict)
    return name, verdict


def _entropy(s: Column) -> Column:
    """Bits a character, from the counts of distinct characters."""
    n = F.length(s)
    letters = F.array_distinct(F.split(s, ""))
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.when(F.length(c) > 0, -share(c) * F.log2(share(c))).otherwise(0.0))).otherwise(F.lit(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Name to a never-null double."""
    filled = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(filled, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(filled, "[^0-9]", ""))
    columns = {
        "url_length": F.length(filled), "host_length": F.length(host), "path_length": F.length(path),
        "host_labels": F.size(F.split(host, r"\.")), "depth": F.regexp_count(path, F.lit("/[^/]+")),
        "digit_ratio": F.coalesce(F.try_divide(digits, F.length(filled)), F.lit(0.0)), "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")), "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), "query_length": F.length(query),
        "fragment": filled.contains("#").cast("int"), "secure": F.lower(filled).startswith("https:").cast("int"),
        "file_suffix": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()}


def _suffix(host: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    labelled: DataFrame | None = None,
    *,
    page_id: str = "page_id",
    url: str = "url",
    sample: int = 20_000,
    trees: int = 8,
    depth: int = 4,
    seed: int = 42,
    scratch: Scratch | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every page.

    A rule decides where one fits, the trees elsewhere. ``labelled`` has (url string, label 0 or 1,
    1 for block); without it the urls that rules decide are the labels. Suffix statistics are, for
    the host's last two labels, the number of all pages and of distinct hosts, on a log scale.
    With labels of one class only, or none, urls without a rule get that class, or allow.
    Null and empty urls have empty host and path and go to the trees like any other; very long ones are read
    whole. Repeated rows and null
    ids are kept, an empty table gives no rows, other columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(page_id).alias("u_id"), F.col(url).alias("u_url"), host.alias("host"), path.alias("path"))
    name, verdict = match_rules(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "u_rule_verdict": verdict, "u_suffix": _suffix(F.col("host"))})
    stats = base.groupBy("u_suffix", "host").count().groupBy("u_suffix")
    # read back, so that Spark can split the pages of a suffix with very many
    stats = scratch.write(stats.agg(F.log1p(F.sum("count")).alias("suffix_pages"), F.log1p(F.count("*")).alias("suffix_hosts")))

    def with_features(df: DataFrame) -> DataFrame:
        wide = df.withColumns(lexical_features(F.col("u_url"), F.col("host"), F.col("path"))).join(stats, "u_suffix", "left")
        return wide.fillna(0.0, ["suffix_pages", "suffix_hosts"])

    names = [*lexical_features(F.lit(""), F.lit(""), F.lit("")), "suffix_pages", "suffix_hosts"]
    if labelled is None:
        known = base.where(F.col("u_rule_verdict").isNotNull()).withColumn("label", (F.col("u_rule_verdict") == "block").cast("double"))
    else:
        h, p = host_and_path(F.col("url"))
        known = labelled.select(F.col("url").alias("u_url"), h.alias("host"), p.alias("path"), F.col("label").cast("double").alias("label"))
        known = known.where(F.col("label").isNotNull()).withColumn("u_suffix", _suffix(F.col("host")))
    known = known.orderBy(F.xxhash64(F.lit(seed), "u_url"), "u_url", "label").limit(sample)
    fitted = VectorAssembler(inputCols=names, outputCol="features").transform(with_features(known)).select("features", "label").cache()
    classes = sorted(r[0] for r in fitted.select("label").distinct().collect())
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(with_features(base))
    if len(classes) == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, cacheNodeIds=False).fit(fitted)
        wide = model.transform(wide).withColumn("block_score", vector_to_array("probability")[1])
    else:
        wide = wide.withColumn("block_score", F.lit(classes[0] if classes else 0.0))
    fitted.unpersist()
    by_model = F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return wide.select(F.col("u_id").alias(page_id), "host", "path", "rule", F.coalesce("u_rule_verdict", by_model).alias("verdict"), "block_score")
