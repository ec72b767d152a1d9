"""Periodic runs of words, by seeds on the diagonals of a text against itself.

A run of period q and length L matches itself q words later over L - q words. All runs of a period
of Q or more therefore share a least overlap, which is the length k of the grams indexed for the periods in [Q, 2Q).
As k is at least 2Q, the next occurrence of a gram inside a run is exactly one smallest period away. So
the pairs of consecutive occurrences hold every seed, and a text of n words gives at most n pairs a
scale, however often a gram occurs. Along one lag the seeds of a run follow each other without a gap:
the first one opens it, the others only carry the furthest covered word on. A gram of the next scale
can only start where a gram of this scale repeats, so ordinary text is left after the first scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import BASE_A, BASE_B, chunks, mix, prefix, span_hash, words


def _partners(values: np.ndarray) -> np.ndarray:
    """Which of the sorted values have an equal neighbour."""
    out = np.zeros(len(values), bool)
    same = values[1:] == values[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _repeated(grams: np.ndarray) -> np.ndarray:
    """Ascending places of all grams that occur more than once, and perhaps of a few others."""
    bits = np.uint64(max(len(grams), 2)).item().bit_length()
    place = np.uint64((1 << bits) - 1)
    packed = np.sort((grams & ~place) | np.arange(len(grams), dtype=np.uint64))
    return np.sort((packed[_partners(packed & ~place)] & place).astype(np.int64))


def _overlap(scale: int, least: int, repeats: int) -> int:
    """The least overlap of a run with itself, one period q on, over all q from ``scale`` up; it never falls with the scale."""
    turn = max(least // repeats, scale)
    return min(max(least, repeats * q) - q for q in (scale, turn, turn + 1))


def runs_of(hashes: np.ndarray, doc: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period; ``doc`` ascends, and no run spans two of its values."""
    none = np.zeros(0, np.int64)
    sums = prefix(hashes, BASE_B)
    salt = mix(doc.astype(np.uint64) + np.uint64(1))  # equal grams of two texts differ
    starts, lags, sizes = [none], [none], [none]
    longest = int(np.bincount(doc).max()) if len(doc) else 0
    at, scale = np.arange(len(hashes)), 1
    while len(at) and max(least, repeats * scale) <= longest:
        k = _overlap(scale, least, repeats)
        at = at[at + k <= len(doc)]
        at = at[doc[at] == doc[at + k - 1]]
        grams = span_hash(sums, at, at + k, BASE_B) ^ salt[at]
        some = _repeated(grams)
        at, grams = at[some], grams[some]
        order = np.argsort(grams, kind="stable")
        place, grams = at[order], grams[order]
        same = grams[1:] == grams[:-1]
        lag = place[1:] - place[:-1]
        seed = same & (lag >= scale) & (lag < 2 * scale)
        starts.append(place[:-1][seed])
        lags.append(lag[seed])
        sizes.append(np.full(int(seed.sum()), k))
        at = np.sort(place[_partners(grams)])
        scale *= 2
    start, lag, k = np.concatenate(starts), np.concatenate(lags), np.concatenate(sizes)
    order = np.lexsort((start, lag))
    start, lag, k = start[order], lag[order], k[order]
    opens = np.flatnonzero(np.concatenate((np.ones(min(len(start), 1), bool), (lag[1:] != lag[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(opens[1:], len(start))[: len(opens)] - 1
    begin, period, end = start[opens], lag[opens], start[last] + k[opens] + lag[opens]
    keep = end - begin >= np.maximum(least, repeats * period)
    begin, end, period = begin[keep], end[keep], period[keep]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _rows(least: int, repeats: int, names: list[str]):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1), 1 << 21):
                opens, ends, doc = words(data, offs)
                begin, end, period = runs_of(span_hash(prefix(data, BASE_A), opens, ends, BASE_A), doc, least, repeats)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                gone = np.zeros(len(doc) + 1, np.int32)
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, end, -1)
                gone = np.cumsum(gone)[:-1] > 0
                owner = doc[begin] if len(begin) else begin
                offsets = np.searchsorted(owner, np.arange(hi - lo + 1))
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begin - first[owner], end - begin, period)], fields=list(run_type))
                whole, kept = data.tobytes(), []
                for i in range(hi - lo):
                    parts = whole[offs[i] : offs[i + 1]].split()
                    out = gone[first[i] : first[i + 1]]
                    kept.append(b" ".join([p for p, g in zip(parts, out.tolist()) if not g] if out.any() else parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    return run


def periodic_runs(docs: DataFrame, *, least: int = 6, repeats: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), kept_text.

    A run is a stretch of words, runs of bytes other than white space, in which words ``period`` apart
    are identical, ``period`` is the smallest such number, the length is at least ``least`` and
    ``repeats`` periods, and no neighbouring word extends it. ``repeats`` is at least 3: with fewer, a
    seed could miss its own smallest period. ``kept_text`` holds the words that no run contains beyond
    its first ``period`` words, joined by one space. Words are compared by 64-bit hashes.

    Null and empty texts have no words, no runs and an empty ``kept_text``. Each row is judged by itself,
    so repeated rows and null ids give a row each, and there is no shuffle. A very long text is held
    whole by its task, with some 100 bytes a word. An empty table gives no rows; other columns are ignored.
    """
    if repeats < 3 or least < 2:
        raise ValueError("repeats must be at least 3 and least at least 2")
    slim = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("body"))
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["own_id", "n_words", "runs", "kept_text"]
    out = slim.mapInArrow(_rows(least, repeats, names), f"own_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")
    return out.withColumnRenamed("own_id", doc_id)


def planted_loops(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: with h the CRC-32 of the id in decimal, texts with h % 10 = 0 loop from word a on, as the query's contract says.

    With g = h // 10 and n words, a = g % n, p = 1 + (n - a) // (3 + g % 8), and word i >= a becomes
    word a + (i - a) % p. A null id plants nothing.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    marked = docs.select(F.col(doc_id).alias("pl_id"), F.col(text).alias("pl_text"), h.alias("pl_h"), g.alias("pl_g"))
    # a step of its own, so that the words are cut once
    marked = marked.withColumn("pl_words", F.when(F.col("pl_h") % 10 == 0, F.regexp_extract_all("pl_text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    marked = marked.withColumn("pl_n", F.size("pl_words").cast("long")).withColumn("pl_a", F.when(F.col("pl_n") > 0, F.col("pl_g") % F.col("pl_n")))
    marked = marked.withColumn("pl_p", F.expr("1 + (pl_n - pl_a) div (3 + pl_g % 8)"))
    looped = F.expr("transform(pl_words, (w, i) -> if(i < pl_a, w, get(pl_words, int(pl_a + (i - pl_a) % pl_p))))")
    return marked.select(F.col("pl_id").alias(doc_id), F.when(F.col("pl_n") > 0, F.array_join(looped, " ")).otherwise(F.col("pl_text")).alias(text))
