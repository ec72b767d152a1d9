"""Near-duplicate groups by 64-bit SimHash.

Links are found exactly, not approximately: two fingerprints within ``radius`` bits agree on at
least one of ``radius + 1`` disjoint bit groups, so equal groups of bits make the buckets. Within a
bucket fingerprints are compared bit-sliced: bit planes hold 64 fingerprints a word, a query adds
one plane after another to carry-save counters of 64 distances at once, and a block is abandoned
when all of its distances exceed the radius.

Equal fingerprints are one node. A bucket sends on a spanning forest of its links, not all pairs. A
bucket of more than ``bucket_limit`` nodes is split by the same argument over the bits that it has
not fixed yet; no pair is lost and no node dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.scratch import Scratch
from tidewatch.llm.text import chunks

SEED = 42
FULL = (1 << 64) - 1


def fingerprint_of(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One fingerprint for each run edges[i]:edges[i+1] of 64-bit hashes: bits set in over half of them; an empty run has 0."""
    counts = np.zeros((len(edges) - 1, 64), np.int64)
    step = 1 << 18
    for lo in range(0, len(hashes), step):
        hi = min(len(hashes), lo + step)
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(edges, lo, side="right")) - 1
        last = int(np.searchsorted(edges, hi, side="left"))
        cuts = np.clip(edges[first:last], lo, hi) - lo
        used = np.diff(np.append(cuts, hi - lo)) > 0
        sums = np.add.reduceat(bits, cuts[used], axis=0, dtype=np.int32)
        counts[first:last][used] += sums
    set_bits = counts * 2 > np.diff(edges)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(ngram: int):
    digest, seed = xxhash.xxh64_intdigest, SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                whole = data.tobytes().lower()  # bytes: A-Z only
                hashes, edges = [], [0]
                for i in range(hi - lo):
                    parts = whole[offs[i] : offs[i + 1]].split()
                    if len(parts) > ngram:
                        joined, at, starts = b" ".join(parts), 0, []
                        for p in parts:
                            starts.append(at)
                            at += len(p) + 1
                        starts.append(at)
                        hashes += [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[ngram:])]
                    elif parts:
                        hashes.append(digest(b" ".join(parts), seed))
                    edges.append(len(hashes))
                prints = fingerprint_of(np.array(hashes, np.uint64), np.array(edges))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(prints.view(np.int64))], ["own_id", "print"])

    return run


def simhash(docs: DataFrame, *, ngram: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(own_id, print): SimHash of the lower-cased text's word shingles, XXH64 with seed 42, repeats included. No word: 0."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("body")).mapInArrow(_fingerprints(ngram), f"own_id {kind}, print long")


def bit_groups(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` cut into n runs of nearly equal length."""
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


class _Forest:
    """Labels of a bucket's nodes; links merge labels towards the smaller."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]


def linked_labels(prints: np.ndarray, run_of: np.ndarray, radius: int, pairs_at_once: int = 1 << 17) -> np.ndarray:
    """Label of each fingerprint (the first of its group's places); ``run_of`` is not falling, and only fingerprints of one run link."""
    n = len(prints)
    prints = prints.reshape(n, -1)  # a wide fingerprint is several 64-bit words
    words = -(-n // 64)
    padded = np.zeros((words * 64, prints.shape[1]), np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # planes[b][w]: bit b of 64 fingerprints
    end = np.searchsorted(run_of, run_of, side="right")
    place = np.arange(n)
    first_word, last_word = (place + 1) // 64, (end - 1) // 64  # only later places of the run
    spans = np.where(end > place + 1, last_word - first_word + 1, 0)
    forest, edges = _Forest(n), np.concatenate(([0], np.cumsum(spans)))
    at = 0
    levels = radius.bit_length()
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + pairs_at_once, side="right")) - 1)
        q = np.repeat(place[at:to], spans[at:to])
        w = first_word[q] + np.arange(len(q)) - (edges[q] - edges[at])
        at = to
        if not len(q):
            continue
        lane = w * 64
        low = np.clip(q + 1 - lane, 0, 64)
        high = np.clip(end[q] - lane, 0, 64)
        ones = np.uint64(FULL)
        upto = lambda k: np.where(k >= 64, ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        alive = upto(high) & ~upto(low)
        # counters start so high that the step beyond the radius carries out of the top one
        spare = (1 << levels) - 1 - radius
        counter = [np.full(len(q), ones if spare >> k & 1 else 0, np.uint64) for k in range(levels)]
        over = ~alive
        for b in range(len(planes)):
            if b % 64 == 0:
                mine = prints[q, b // 64]
            carry = planes[b][w] ^ (np.uint64(0) - ((mine >> np.uint64(b % 64)) & np.uint64(1)))
            for k in range(levels):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 4 == 3:
                keep = over != ones
                if not keep.all():
                    q, w, mine, over = q[keep], w[keep], mine[keep], over[keep]
                    counter = [c[keep] for c in counter]
                    if not len(q):
                        break
        if len(q):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            forest.link(q[i], w[i] * 64 + j)
    return forest.label


def _bucket_links(radius: int):
    """Sorted (mask, value, print) rows to a spanning forest (a, b) of each bucket; a bucket may span batches."""

    def flush(mask, value, prints) -> pa.RecordBatch:
        new = np.ones(len(mask), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        label = linked_labels(prints.view(np.uint64), np.cumsum(new), radius)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[at]), pa.array(prints[label[at]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) if len(held[0]) else np.zeros(0, bool)
            cut = int(np.argmax(last)) if len(last) else 0
            if cut > 1 << 16:
                yield flush(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield flush(*held)

    return run


def links(nodes: DataFrame, radius: int, scratch: Scratch, bucket_limit: int = 20_000) -> DataFrame:
    """Distinct fingerprints (print) to links (a, b) that connect all pairs within ``radius`` bits."""
    # with ``radius`` free bits left a bucket has at most 2**radius nodes, so splitting always ends
    bucket_limit = max(bucket_limit, 2 << radius)
    groups = bit_groups(list(range(64)), radius + 1)
    levels = [(set(g), _mask(g)) for g in groups]
    masks = F.array(*(F.lit(m) for _, m in levels))
    rows = nodes.select("print", F.explode(masks).alias("mask")).withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
    out = None
    while True:
        sizes = rows.groupBy("mask", "value").count().where("count > 1")
        sizes = scratch.write(sizes)
        warm = rows.join(sizes.where(F.col("count") <= bucket_limit).drop("count"), ["mask", "value"], "left_semi")
        sorted_rows = warm.repartition("mask", "value").sortWithinPartitions("mask", "value", "print").select("mask", "value", "print")
        found = sorted_rows.mapInArrow(_bucket_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("count") > bucket_limit)
        hot_masks = {r["mask"] for r in large.select("mask").distinct().collect()}
        deeper = []
        for fixed, m in levels:
            free = [b for b in range(64) if b not in fixed]
            if m in hot_masks and len(free) > radius:
                deeper += [(m, fixed | set(g), _mask(sorted(fixed | set(g)))) for g in bit_groups(free, radius + 1)]
        if not deeper:
            return out
        hot = rows.join(large.drop("count"), ["mask", "value"], "left_semi").select("mask", "print")
        finer = F.create_map(*(x for m in hot_masks for x in (F.lit(m), F.array(*(F.lit(new) for old, _, new in deeper if old == m)))))
        rows = hot.select("print", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        rows = scratch.write(rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask"))))
        levels = list({new: (fixed, new) for _, fixed, new in deeper}.values())


def near_duplicate_groups(
    docs: DataFrame, *, ngram: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text", bucket_limit: int = 20_000, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable over links of at most ``radius`` differing bits.

    Texts without words (null, empty, spaces) have fingerprint zero and link like any other. Null ids
    never name a group that has an id; a group of null ids only has a null component. Repeated rows
    are kept. A very long text is hashed whole, in steps of bounded memory beyond its own shingles' hashes. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(simhash(docs, ngram=ngram, doc_id=doc_id, text=text))
    nodes = scratch.write(rows.groupBy("print").agg(F.min("own_id").alias("least")))
    edges = scratch.write(links(nodes.select("print"), radius, scratch, bucket_limit).distinct())
    roots = components(edges, scratch)
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    # read back, so that Spark can split a large component
    named = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(named, "root").select("print", "component_id")
    out = rows.join(named, "print")
    return out.select(F.col("own_id").alias(doc_id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
