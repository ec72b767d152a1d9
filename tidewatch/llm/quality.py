"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled good) and one of
all raw text, give each document a log importance weight: the sum of log p_target / p_raw over its
n-grams. Adding Gumbel noise and keeping the largest ``k`` sums is sampling without replacement in
proportion to the weights.

N-grams are of two kinds: words (one and two), and word shapes (one to three): length, case, digits,
symbols, end of sentence, and whether the word repeats one of the two before it.

The raw counts cover every whole document. Labels are used through a bounded sample
(``max_labels`` documents, lowest by a hash of the id): four fifths fit the target model, one fifth
sets how many documents are kept. Memory is ``buckets`` counters, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch
from tidewatch.llm.text import BASE_A, chunks, mix, prefix, span_hash, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()"]] = 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A small integer for the look of each word."""

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return sums[ends] - sums[starts]

    size, upper = ends - starts, count(_UPPER)
    case = np.where(upper == 0, 0, np.where((upper == 1) & (_UPPER[data[starts]] == 1), 1, np.where(upper * 2 >= size, 3, 2)))
    again = np.zeros(len(word), np.int64)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    again[2:] |= ((word[2:] == word[:-2]) & (doc[2:] == doc[:-2])).astype(np.int64) * 2
    code = np.minimum(size, 23) // 3
    for part, base in ((case, 4), (np.minimum(count(_DIGIT), 2), 3), (np.minimum(count(_SYMBOL), 3), 4), (_STOP[data[ends - 1]].astype(np.int64), 2), (again, 4)):
        code = code * base + part
    return code.astype(np.uint64)


def _features(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of a chunk of whole texts."""
    starts, ends, doc = words(data, offs)
    word = span_hash(prefix(_LOWER[data], BASE_A), starts, ends, BASE_A)
    shape = _shapes(data, starts, ends, doc, word)
    found, owners = [], []
    for salt, (stream, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        m = len(stream) - n + 1
        if m <= 0:
            continue
        h = np.full(m, salt + 1, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + stream[k : k + m])
        inside = doc[:m] == doc[n - 1 : n - 1 + m]
        found.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        owners.append(doc[:m][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _count(buckets: int):
    """(body, part) rows to one row a bucket and task: n-grams of all texts, and of target texts (part = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            part = np.array(batch.column(1).fill_null(0)) == 1
            for lo, hi, data, offs in chunks(batch.column(0)):
                bucket, owner = _features(data, offs, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                if part[lo:hi].any():
                    target += np.bincount(bucket[part[lo:hi][owner]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return run


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                bucket, owner = _features(data, offs, len(ratio))
                weight = np.bincount(owner, ratio[bucket], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.round(weight, 6), pa.float64())], ["own_id", "tag", "log_weight"])

    return run


def best_threshold(scores: list[float], good: list[bool]) -> float:
    """The cut (documents at or above it count as good) with the best mean of the two classes' hit rates; -inf with one class only."""
    pairs = sorted(zip(scores, good))
    n_good, n_bad = sum(good), len(good) - sum(good)
    if not n_good or not n_bad:
        return -math.inf
    best, cut, good_below, bad_below = 0.5, -math.inf, 0, 0
    for i, (s, g) in enumerate(pairs):
        if i and s != pairs[i - 1][0]:
            value = ((n_good - good_below) / n_good + bad_below / n_bad) / 2
            if value > best:
                best, cut = value, (s + pairs[i - 1][0]) / 2
        good_below += g
        bad_below += not g
    return cut


def top_k(rows: DataFrame, k: int, key: str, tie: list[str], hold: int = 1 << 13) -> DataFrame:
    """``rows``, a written table, with the boolean ``kept``: the k largest by ``key`` (finite numbers), ties by ``tie``.

    Counts over ever finer slices of the key close in on the k-th place until at most ``hold`` rows are
    left around it; only those are sorted. If more rows than that have one key, they are told apart by
    a hash of ``tie`` and of the row's place in the table instead.
    """
    n, low, high = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    above = 0
    if not 0 < k < n:
        return rows.withColumn("kept", F.lit(k > 0))
    while n > hold and low < high:
        # 1,024 slices, whatever the rows
        at = F.least(F.floor((F.col(key) - low) / (high - low) * 1024), F.lit(1023)).alias("slice")
        within = rows.where(F.col(key).between(low, high)).groupBy(at)
        for _, n, low, high in sorted(within.agg(F.count("*"), F.min(key), F.max(key)).collect(), reverse=True):
            if above + n >= k:
                break
            above += n
    edge = rows.where(F.col(key).between(low, high))
    rest = rows.where(~F.col(key).between(low, high)).withColumn("kept", F.col(key) > high)
    if n > hold:
        drawn = edge.withColumn("tk_draw", F.xxhash64(*tie, F.monotonically_increasing_id()).cast("double"))
        edge = top_k(drawn, k - above, "tk_draw", tie, hold).drop("tk_draw")
    else:
        order = Window.partitionBy(F.lit(0)).orderBy(F.col(key).desc(), *tie)  # at most ``hold`` rows
        edge = edge.withColumn("kept", F.row_number().over(order) <= k - above)
    return edge.unionByName(rest)


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    buckets: int = 1 << 16,
    max_labels: int = 20_000,
    smoothing: float = 1.0,
    temperature: float = 1.0,
    k: int | None = None,
    seed: int = 42,
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, tag (hash of the text), log_weight, sample_key, kept for every document.

    ``labels`` has (doc_id, label): 1 good, 0 bad; of several labels of an id the lowest counts, nulls
    do not. ``k`` is the number to keep; by default the number of documents whose weight reaches
    the cut that best parts held-out good from bad labels (all documents if there is no cut).
    ``temperature`` scales the noise. Texts without words (null, empty) have weight 0. Noise comes
    from a hash of id and text, so reruns agree; repeated rows share it, and are kept as far as k
    goes. Very long texts are counted whole, and their weights are sums, not means. Null ids are ordinary, unlabelled ids. An empty table gives no rows; other columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    filled = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("own_id"), F.xxhash64(filled).alias("tag"), filled.alias("body"))
    rated = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("l_id")).agg((F.min(label) >= 1).alias("good"))
    rated = rated.withColumn("l_draw", F.xxhash64(F.lit(seed), "l_id")).orderBy("l_draw", "l_id").limit(max_labels)
    rated = scratch.write(rated.select("l_id", "good", (F.pmod("l_draw", F.lit(5)) == 0).alias("held")))
    fit = rated.where("good and not held").select("l_id", F.lit(1).alias("part"))

    # at most max_labels ids: a bounded broadcast
    marked = base.join(F.broadcast(fit), F.col("own_id") == F.col("l_id"), "left").select("body", "part")
    counts = marked.mapInArrow(_count(buckets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counts.collect():  # one row a bucket
        raw[b], target[b] = r, t
    if target.sum():
        ratio = np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))
    else:
        ratio = np.zeros(buckets)

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = scratch.write(base.mapInArrow(_score(ratio), f"own_id {kind}, tag long, log_weight double"))
    if k is None:
        held = scored.join(F.broadcast(rated.where("held")), F.col("own_id") == F.col("l_id")).select("log_weight", "good").collect()  # a fifth of max_labels
        cut = best_threshold([r[0] for r in held], [r[1] for r in held])
        k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "own_id", "tag"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(unit)) * F.lit(float(temperature)))
    return top_k(keyed, k, "sample_key", ["own_id", "tag"]).withColumnRenamed("own_id", doc_id)
