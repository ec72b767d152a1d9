"""Near-duplicate groups at a given similarity of word shingles, by wide SimHash.

The similarity is the Jaccard similarity of shingle sets: bands and fingerprints are both of a text's
distinct shingles, so that a repeated line or passage counts once.

At a Jaccard similarity of 0.8 about 15 % of the bits of a SimHash differ: ten of 64. Equal groups of
bits would have to be five bits wide to catch those, so here the buckets are min-wise bands instead
(each the minima of a few hashes over a text's shingles), and fingerprints have 512 bits, so that the
share of differing bits tells similarities apart (standard deviation near 0.8: 0.016). Within a bucket
the comparison is the bit-sliced one of ``simhash``, with as many planes as bits.

Fingerprints only propose: the texts that they chain together within a bucket are a candidate group.
The members' shingle sets are joined to it, and a search from member to member keeps the links whose
exact similarity reaches the threshold. It compares each member found with all that are not found yet,
so what is linked exactly within a candidate group stays linked, whatever estimate led there. Groups that
several bands found are merged where they share their smallest member. A group of over ``members`` is cut into blocks, and each pair of blocks is searched on its own, so that no task
holds more than about two blocks of one group.

With the defaults a pair at a similarity of 0.8 shares no band with a probability of 3e-5, and lies
beyond the radius with about the same; above 0.85 both vanish. A pair below the threshold is never a
link; it shares a group only through a chain of links that all reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.scratch import Scratch
from tidewatch.llm.simhash import fingerprint_of, linked_labels
from tidewatch.llm.tables import id_key, text_key
from tidewatch.llm.text import BASE_A, BASE_B, chunks, mix, prefix, span_hash, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bit_radius(similarity: float, bits: int, margin: float = 2.25) -> int:
    """Differing bits to allow for a Jaccard ``similarity``: what the angle between the shingle vectors gives, and ``margin`` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text's lower-cased word shingles (fewer words: the whole sequence), ascending, and the edges of each text's run."""
    starts, ends, doc = words(data, offs)
    word = span_hash(prefix(_LOWER[data], BASE_A), starts, ends, BASE_A)
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.cumsum(count) - count
    many = np.maximum(count - ngram + 1, np.minimum(count, 1))
    edges = np.concatenate(([0], np.cumsum(many)))
    at = np.repeat(first - edges[:-1], many) + np.arange(edges[-1])
    hashes = span_hash(prefix(word, BASE_B), at, at + np.repeat(np.minimum(count, ngram), many), BASE_B)
    owner = np.repeat(np.arange(len(many)), many)
    hashes = hashes[np.lexsort((hashes, owner))]  # owner is not falling, so it stays as it is
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(many)))))


def signatures(hashes: np.ndarray, edges: np.ndarray, fingerprint_words: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprint (texts x words) and min-wise band keys (texts x bands); texts without shingles share all of theirs."""
    rng = np.random.default_rng(42)
    salts = rng.integers(0, 1 << 63, fingerprint_words, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    prints = np.stack([fingerprint_of(mix(hashes ^ salt), edges) for salt in salts], axis=1)
    used = np.diff(edges) > 0
    keys = np.full((len(edges) - 1, bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
    for band in range(bands if used.any() else 0):
        key = keys[used, band]
        for p in range(band * rows, band * rows + rows):
            v = hashes * odd[0, p]
            v ^= v >> np.uint64(32)
            v *= odd[1, p]
            key = mix(key + np.minimum.reduceat(v, edges[:-1][used]))
        keys[used, band] = key
    return prints, keys


def _sign(ngram: int, fingerprint_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                hashes, edges = shingle_hashes(data, offs, ngram)
                prints, keys = signatures(hashes, edges, fingerprint_words, bands, rows)
                packed = pa.Array.from_buffers(pa.binary(8 * fingerprint_words), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                whole = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(BASE_B)))))
                whole = pa.array((whole[edges[1:]] - whole[edges[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), packed, lists, whole], ["own_id", "tag", "print", "bands", "whole"])

    return run


def _bucket_groups(radius: int):
    """Rows sorted by bucket (band, i, j) to the members (gid, node) of each group that links within the radius chain together; a bucket may span batches.

    The group's id follows from its members, so that a group found in several buckets is one.
    """

    def flush(bucket: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(node), bool)
        new[1:] = (bucket[1:] != bucket[:-1]).any(axis=1)
        label = linked_labels(prints, np.cumsum(new), radius)
        at = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        at = at[np.argsort(label[at], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], label[at][1:] != label[at][:-1]))) if len(at) else at
        total = np.add.reduceat(mix(node[at].view(np.uint64) + np.uint64(BASE_A)), first) if len(at) else np.zeros(0, np.uint64)
        gid = np.repeat(total, np.diff(np.append(first, len(at))))
        return pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)), pa.array(node[at])], ["gid", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            now = [np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1), batch.column(3).to_numpy(), prints]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.argmax((held[0] == held[0][-1]).all(axis=1)))
            if cut > 1 << 13:
                yield flush(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if held is not None:
            yield flush(*held)

    return run


def block_pairs(rows: DataFrame) -> DataFrame:
    """Rows (node, blocks, ...) once for each pair (i, j) of a group's blocks that holds the node's own block: any two nodes of a group meet in some pair."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")


def split_groups(groups: DataFrame, members: int, scratch: Scratch) -> DataFrame:
    """(gid, node) with each group of over ``members`` nodes replaced by groups of pairs of its blocks."""
    large = scratch.write(groups.groupBy("gid").count().where(F.col("count") > members).select("gid", F.ceil(F.col("count") / members).cast("long").alias("blocks")))
    rows = block_pairs(groups.join(large, "gid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))))
    return rows.select(F.when(F.col("blocks") > 1, F.xxhash64("gid", "i", "j")).otherwise(F.col("gid")).alias("gid"), "node")


def merge_groups(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(gid, node) with one group for all that have their smallest node in common; gid is that node.

    The bands of near copies find nearly the same group again and again, mostly with the same smallest
    node. Groups are not merged through any other node, so that chains of groups do not grow into one.
    """
    first = scratch.write(groups.groupBy("gid").agg(F.min("node").alias("first")))
    return groups.join(first, "gid").select(F.col("first").alias("gid"), "node").distinct()


def candidate_groups(nodes: DataFrame, radius: int, scratch: Scratch, block: int) -> DataFrame:
    """(node, print, bands) to groups (gid, node) that hold together all pairs of nodes which share a band and differ in at most ``radius`` bits.

    A bucket of over ``block`` nodes is cut into blocks, and each pair of blocks is a bucket of its
    own, so that no task holds more than about two blocks and no pair is left out.
    """
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    sizes = scratch.write(keyed.groupBy("band").count().where("count > 1").select("band", F.ceil(F.col("count") / block).cast("long").alias("blocks")))
    rows = block_pairs(nodes.select("node", "print", F.explode("bands").alias("band")).join(sizes, "band"))
    rows = rows.select("band", "i", "j", "node", "print")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node").mapInArrow(_bucket_groups(radius), "gid long, node long")


def exact_forest(node: np.ndarray, hashes: np.ndarray, edges: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) at or above ``similarity`` that connect all members of a group which such links connect; runs of ``hashes`` are sets."""
    code = np.unique(hashes, return_inverse=True)[1]
    size = np.diff(edges)
    mine = lambda x: code[edges[x] : edges[x + 1]]
    mark = np.zeros(len(hashes), bool)
    rest, rest_size, rest_code = np.arange(len(node)), size, code  # not found yet
    found: list[int] = []
    a, b = [], []
    while len(rest):
        if found:
            x = found.pop()
        else:
            x = int(rest[0])
            rest, rest_size, rest_code = rest[1:], rest_size[1:], rest_code[rest_size[0] :]
            if not len(rest):
                break
        mark[mine(x)] = True
        both = np.add.reduceat(mark[rest_code], np.cumsum(rest_size) - rest_size, dtype=np.int64)
        mark[mine(x)] = False
        near = both / (size[x] + rest_size - both) >= similarity
        if near.any():
            a.append(np.full(near.sum(), node[x]))
            b.append(node[rest[near]])
            found += rest[near].tolist()
            rest_code = rest_code[np.repeat(~near, rest_size)]
            rest, rest_size = rest[~near], rest_size[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(similarity: float, hold: int = 1 << 20):
    """Rows (gid, node, set) sorted by gid to exact links (a, b); a group may span batches."""

    def flush(gid: np.ndarray, node: np.ndarray, sets: list[bytes]) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1], [True])))
        found = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            edges = np.cumsum([0] + [len(x) // 8 for x in sets[lo:hi]])
            found.append(exact_forest(node[lo:hi], np.frombuffer(b"".join(sets[lo:hi]), np.uint64), edges, similarity))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(2)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, node, sets, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gid, node = np.concatenate((gid, batch.column(0).to_numpy())), np.concatenate((node, batch.column(1).to_numpy()))
            now = batch.column(2).to_pylist()
            sets += now
            held += sum(map(len, now)) // 8
            cut = int(np.searchsorted(gid, gid[-1]))
            if held > hold and cut:
                yield flush(gid[:cut], node[:cut], sets[:cut])
                gid, node, sets = gid[cut:], node[cut:], sets[cut:]
                held = sum(map(len, sets)) // 8
        if len(gid):
            yield flush(gid, node, sets)

    return run


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                hashes, edges = shingle_hashes(data, offs, ngram)
                raw = hashes.tobytes()
                sets = [raw[8 * x : 8 * y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def similar_groups(
    docs: DataFrame,
    *,
    ngram: int = 5,
    similarity: float = 0.8,
    fingerprint_words: int = 8,
    bands: int = 20,
    rows: int = 4,
    block: int = 8192,
    members: int = 256,
    doc_id: str = "doc_id",
    text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, tag, first_id, first_tag of every row: its text's hash, and the id and text hash of the first row of its group.

    Rows are ordered by id, null last, then text hash. Texts without words (null, empty, spaces) are one
    group; very long texts are compared whole; a text of fewer than ``ngram`` words is one shingle. Repeated rows are kept. An empty table
    gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("own_id"), text_key(text).alias("tag"), F.col(text).alias("body"))
    signed = slim.mapInArrow(_sign(ngram, fingerprint_words, bands, rows), f"own_id {kind}, tag long, print binary, bands array<long>, whole long")
    signed = scratch.write(signed)
    least = F.min(F.struct(id_key("own_id").alias("key"), F.col("own_id").alias("id"), F.col("tag").alias("tag"))).alias("least")
    # a node is a set of shingles (``whole`` is the set's own hash); the ids of nodes are fixed once the table is written, and no result depends on them
    same = ["print", "bands", "whole"]
    nodes = scratch.write(signed.groupBy(*same).agg(least).withColumn("node", F.monotonically_increasing_id()))
    # verification is exact, so the radius is wide
    radius = bit_radius(similarity, 64 * fingerprint_words, margin=4.0)
    groups = scratch.write(candidate_groups(nodes, radius, scratch, block).distinct())
    groups = scratch.write(merge_groups(groups, scratch))
    # the shingles of a node are those of its first row's text
    found = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", F.col("least.key").alias("key"), F.col("least.tag").alias("tag"))
    bodies = slim.select(id_key("own_id").alias("key"), "tag", "body").join(found, ["key", "tag"]).select("node", "body")
    sets = scratch.write(bodies.mapInArrow(_sets(ngram), "node long, set binary").dropDuplicates(["node"]))
    rows_of = split_groups(groups, members, scratch).join(sets, "node").select("gid", "node", "set").repartition("gid").sortWithinPartitions("gid")
    edges = scratch.write(rows_of.mapInArrow(_verified(similarity), "a long, b long").distinct())
    scratch.drop(groups, sets)
    roots = components(edges, scratch)
    rooted = scratch.write(nodes.join(roots, "node", "left").select(*same, "least", F.coalesce("root", "node").alias("root")))
    # read back, so that Spark can split a large group
    first = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("first")))
    named = rooted.join(first, "root").select(*same, "first")
    return signed.join(named, same).select(F.col("own_id").alias(doc_id), "tag", F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag"))
