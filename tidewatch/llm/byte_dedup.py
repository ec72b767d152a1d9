"""Exact removal of repeated byte strings, by suffix arrays over shards.

A repeated string of ``length`` bytes is found in three steps, each exact.

1. Each run of ``length`` bytes (a window) names its anchor, the ``gram``-byte string in it with the
   smallest hash. Equal windows have equal anchors. Anchors are counted in Spark; windows whose
   anchor occurs once are unique and go no further.
2. The windows that share one occurrence of an anchor make a segment. Equal segments are one class,
   so that thousands of copies of a passage weigh as much as one. A class that occurs twice is
   repeated as a whole.
3. The classes that occur once are dealt out by anchor, next to all other classes of that anchor.
   Each shard of a few hundred kilobytes gets a suffix array by induced sorting and permuted common
   prefixes; a window is repeated if its neighbour in the array shares ``length`` bytes.

An anchor with over ``group_limit`` classes (a passage in very many contexts) is split: its windows
are halved by their distance to the anchor, and each half is grouped by the bytes that all its
windows contain. Halving ends at single windows, so no group stays large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch
from tidewatch.llm.suffix import common_prefixes, suffix_array
from tidewatch.llm.tables import LAST_ID
from tidewatch.llm.text import BASE_A, BASE_B, anchors, chunks, mix, pieces, prefix, rolling_hash, span_hash

CHUNK = 1 << 20
SHARD = 1 << 19
#: Not a byte of UTF-8.
GAP = 0xFF

PIECE = "m long, c1 long, c2 long, key long, a int, b int, off int, lead int, n int, many boolean, body binary"


def _anchored(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, place of the anchor, its hash) of each segment of a chunk."""
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    grams = rolling_hash(data, gram, BASE_B)
    at = anchors(grams, length - gram + 1)[:n]
    inside = np.repeat(offs[1:], np.diff(offs))[:n] - np.arange(n) >= length
    edge = np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])))
    # a text's last window and the next text's first are apart even where no window between is invalid
    starts = offs[:-1][offs[:-1] < n]
    edge[starts] = True
    first = np.flatnonzero(edge)
    end = np.append(first[1:], n)
    ok = inside[first]
    return first[ok], end[ok], at[first[ok]], grams[at[first[ok]]].view(np.int64)


def _owners(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, side="right") - 1


def _anchor_rows(length: int, gram: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offs, shift in pieces(batch.column(2), chunk, length - 1):
                first, _, at, m = _anchored(data, offs, length, gram)
                doc = _owners(offs, first)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids[lo + doc]), pa.array(tags[lo + doc]), pa.array((at - offs[doc] + shift).astype(np.int32))], ["m", "did", "tag", "place"])

    return run


def _segment_rows(length: int, gram: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            edges, places = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for lo, hi, data, offs, shift in pieces(batch.column(2), chunk, length - 1):
                first, end, at, m = _anchored(data, offs, length, gram)
                wanted = np.zeros(len(data) + 1, bool)
                row = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
                spot = offs[row] + places[edges[lo] : edges[hi]] - shift
                wanted[spot[(spot >= offs[row]) & (spot < offs[row + 1])]] = True
                pick = wanted[at]
                first, end, at, m = first[pick], end[pick], at[pick], m[pick]
                doc, lead, stop = _owners(offs, first), at - first, end + length - 1
                c1 = mix(span_hash(prefix(data, BASE_A), first, stop, BASE_A) + lead.astype(np.uint64)).view(np.int64)
                c2 = mix(span_hash(prefix(data, BASE_B), first, stop, BASE_B) + lead.astype(np.uint64)).view(np.int64)
                # within one text the bytes of a class are sent once
                order = np.lexsort((first, c2, c1, doc))
                again = np.zeros(len(first), bool)
                again[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (c1[order][1:] == c1[order][:-1]) & (c2[order][1:] == c2[order][:-1])
                whole = data.tobytes()
                body = [None if g else whole[a:b] for g, a, b in zip(again.tolist(), first.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m), pa.array(c1), pa.array(c2), pa.array(ids[lo + doc]), pa.array(tags[lo + doc]), pa.array((first - offs[doc] + shift).astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(body, pa.binary())],
                    ["m", "c1", "c2", "did", "tag", "start", "lead", "n", "body"],
                )

    return run


def _shard_ranges(length: int):
    """Pieces sorted by key to the repeated windows (lo, hi) of their classes. A shard ends between keys."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        gap = bytes([GAP])
        text = np.frombuffer(gap.join(r[-1] for r in rows) + gap, np.uint8)
        sizes = np.array([len(r[-1]) + 1 for r in rows])
        starts = np.cumsum(sizes) - sizes
        phi, plcp = common_prefixes(text, suffix_array(text), length)
        hit = plcp >= length
        repeated = hit.copy()
        repeated[phi[hit]] = True
        for (m, c1, c2, _, off, n, many, _), s in zip(rows, starts.tolist()):
            if many:
                continue
            turn = np.flatnonzero(np.diff(np.concatenate(([0], repeated[s : s + n].view(np.int8), [0]))))
            for x, y in turn.reshape(-1, 2).tolist():
                yield m, c1, c2, off + x, off + y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["m", "c1", "c2", "lo", "hi"])

        held, size, key = [], 0, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for r in zip(*cols):
                if r[3] != key and size >= SHARD:
                    yield pack(list(solve(held)))
                    held, size = [], 0
                key = r[3]
                held.append(r)
                size += len(r[-1]) + 1
        if held:
            yield pack(list(solve(held)))

    return run


def _halves(length: int):
    """Each piece to its parts in the two halves of its range of distances [a, b); the key is of the bytes that all windows of a half share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, c1, c2, key, a, b, off, lead, n, many, body in zip(*(batch.column(i).to_pylist() for i in range(11))):
                middle = (a + b) // 2
                for x, y in ((a, middle), (middle, b)):
                    # window r of the piece is lead - r from the anchor
                    r0, r1 = max(0, lead - y + 1), min(n, lead - x + 1)
                    if r0 >= r1:
                        continue
                    part = body[r0 : r1 - 1 + length]
                    core = body[lead - x : lead - y + 1 + length]
                    raw = np.frombuffer(core, np.uint8)
                    new = int(mix(rolling_hash(raw, len(raw), BASE_A) ^ np.uint64(key & ((1 << 64) - 1)) ^ np.uint64(x << 32 | y))[0])
                    out.append((m, c1, c2, new - (1 << 64) if new >> 63 else new, x, y, off + r0, lead - r0, r1 - r0, many, part))
            columns = list(zip(*out)) if out else [()] * 11
            types = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.bool_(), pa.binary()]
            names = ["m", "c1", "c2", "key", "a", "b", "off", "lead", "n", "many", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _class_ranges(pieces: DataFrame, length: int, group_limit: int, scratch: Scratch) -> DataFrame:
    """Repeated windows (m, c1, c2, lo, hi) of the classes in ``pieces`` that are not ``many``."""
    found = []
    while True:
        sizes = pieces.groupBy("key").agg(F.count("*").alias("k"), F.max(F.col("b") - F.col("a")).alias("span"))
        hot = scratch.write(sizes.where((F.col("k") > group_limit) & (F.col("span") > 1)).select("key"))
        any_hot = bool(hot.head(1))
        calm = pieces.join(hot, "key", "left_anti") if any_hot else pieces
        calm = calm.repartition("key").sortWithinPartitions("key").select("m", "c1", "c2", "key", "off", "n", "many", "body")
        found.append(scratch.write(calm.mapInArrow(_shard_ranges(length), "m long, c1 long, c2 long, lo int, hi int")))
        if not any_hot:
            break
        halves = pieces.join(hot, "key", "left_semi").select(*[c.split()[0] for c in PIECE.split(", ")]).mapInArrow(_halves(length), PIECE)
        halves = scratch.write(halves.withColumn("content", F.sha2("body", 256)))
        # equal parts of different classes, or a part of a repeated class, are repeated as a whole
        by = ["key", "lead", "content"]
        same = halves.groupBy(*by).agg(F.count("*").alias("k"), F.max("many").alias("any_many"), F.min(F.struct("m", "c1", "c2")).alias("one"))
        same = scratch.write(same)
        twice = same.where((F.col("k") > 1) | F.col("any_many")).select(*by)
        found.append(halves.where(~F.col("many")).join(twice, by, "left_semi").select("m", "c1", "c2", F.col("off").alias("lo"), (F.col("off") + F.col("n")).alias("hi")))
        kept = halves.join(same, by).where(F.struct("m", "c1", "c2") == F.col("one"))
        kept = kept.withColumn("many", (F.col("k") > 1) | F.col("any_many"))
        alone = same.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
        pieces = scratch.write(kept.join(alone, "key", "left_semi").select(*[c.split()[0] for c in PIECE.split(", ")]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(length: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            edges, packed = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column(1), CHUNK):
                whole, kept, sizes, gone, spans = data.tobytes(), [], [], [], []
                for i in range(hi - lo):
                    raw = whole[offs[i] : offs[i + 1]]
                    mine = packed[edges[lo + i] : edges[lo + i + 1]]
                    runs = []
                    if len(mine):
                        mine = np.sort(mine)
                        start = mine >> 32
                        reach = np.maximum.accumulate(start + (mine & 0xFFFFFFFF) + length - 1)
                        new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                        runs = [{"start": a, "end": b} for a, b in zip(start[new].tolist(), reach[np.append(new[1:], len(mine)) - 1].tolist())]
                    at, parts = 0, []
                    for r in runs:
                        parts.append(raw[at : r["start"]])
                        at = r["end"]
                    kept.append(b"".join([*parts, raw[at:]]))
                    sizes.append(len(raw))
                    gone.append(sum(r["end"] - r["start"] for r in runs))
                    spans.append(runs)
                span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span_type)], names
                )

    return run


def remove_repeated_bytes(
    docs: DataFrame, *, length: int = 400, gram: int = 24, doc_id: str = "doc_id", text: str = "text", group_limit: int = 1024, chunk: int = CHUNK, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, spans (maximal removed runs, [start, end)).

    Every byte goes that is covered by a ``length``-byte string of its text that also starts anywhere
    else, in another text or at another place of the same one. Strings are judged on the input and
    do not cross texts. Null text is empty; null ids are ordinary ids; repeated rows are texts of
    their own, so they remove each other. A very long text is searched in pieces of ``chunk`` bytes that
    overlap by ``length`` - 1, so that only the text itself and its spans are held whole. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be in 1..length")
    scratch = scratch or Scratch(docs.sparkSession)
    filled = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("own_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64(filled).alias("tag"), filled.alias("body"))
    slim = base.select("did", "tag", "body").where(F.octet_length("body") >= length)

    places = slim.mapInArrow(_anchor_rows(length, gram, chunk), "m long, did long, tag long, place int")
    # read back, both sides of the join are plain shuffles, and Spark can split a hot anchor's rows
    often = scratch.write(places.groupBy("m").count().where("count > 1").select("m"))
    wanted = scratch.write(places.join(often, "m", "left_semi").groupBy("did", "tag").agg(F.collect_set("place").alias("places")))
    rows = slim.join(wanted, ["did", "tag"]).select("did", "tag", "body", "places")
    segments = scratch.write(rows.mapInArrow(_segment_rows(length, gram, chunk), "m long, c1 long, c2 long, did long, tag long, start int, lead int, n int, body binary"))
    scratch.drop(wanted, often)

    classes = scratch.write(segments.groupBy("m", "c1", "c2").agg(F.count("*").alias("rows"), F.min("did").alias("one")))
    mixed = classes.groupBy("m").agg(F.count("*").alias("kinds"), F.count_if(F.col("rows") == 1).alias("lone")).where("kinds > 1 and lone > 0").select("m")
    wanted_classes = classes.join(mixed, "m", "left_semi").select("m", "c1", "c2", F.col("one").alias("did"), (F.col("rows") > 1).alias("many"))
    # rows with the same id (or null ids) all have the smallest did: one piece stands for a class
    pieces = segments.where(F.col("body").isNotNull()).join(wanted_classes, ["m", "c1", "c2", "did"]).dropDuplicates(["m", "c1", "c2"])
    pieces = pieces.select("m", "c1", "c2", F.col("m").alias("key"), F.lit(0).alias("a"), F.lit(length).alias("b"), F.lit(0).alias("off"), "lead", "n", "many", "body")
    ranges = _class_ranges(scratch.write(pieces), length, group_limit, scratch)

    narrow = segments.select("m", "c1", "c2", "did", "tag", "start", "n")
    whole = narrow.join(classes.where("rows > 1").select("m", "c1", "c2"), ["m", "c1", "c2"], "left_semi").select("did", "tag", "start", "n")
    part = narrow.drop("n").join(ranges, ["m", "c1", "c2"]).select("did", "tag", (F.col("start") + F.col("lo")).alias("start"), (F.col("hi") - F.col("lo")).alias("n"))
    note = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    spans = scratch.write(whole.unionByName(part).groupBy("did", "tag").agg(F.collect_set(note).alias("notes")))
    scratch.drop(segments, classes)

    joined = base.join(spans, ["did", "tag"], "left").select("own_id", "body", F.coalesce("notes", F.array().cast("array<bigint>")).alias("notes"))
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["own_id", "kept", "n_bytes", "n_removed", "spans"]
    out = joined.mapInArrow(_cut(length, names), f"own_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("own_id", doc_id)
