"""Exact substring dedup over word windows.

Every window of ``window`` consecutive words gets a Rabin-Karp hash; windows are counted in Spark,
and the repeated ones of a document merge into maximal removal intervals.

Sending each window through a shuffle would move several times the corpus. So a first pass proves
most windows unique: each window names its anchor, the ``gram``-word run in it with the smallest
hash. Equal windows have equal anchors, and neighbouring windows mostly share one, so that a count
of anchors (about two for each 14 words) is enough to drop every window whose anchor occurs once. No
repeated window is lost this way. The windows left are counted by their own 96-bit hash.

Hot passages: counts are combined before each shuffle, and the joins back to the occurrences have
one row a hash on the counted side, so that Spark can split a hot key's other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch
from tidewatch.llm.tables import LAST_ID, text_key
from tidewatch.llm.text import BASE_A, BASE_B, anchors, chunks, prefix, rolling_hash, span_hash, words


class _Windows:
    """Words, windows and anchors of one chunk of whole texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, gram: int):
        starts, ends, self.doc = words(data, offs)
        self.first = np.searchsorted(self.doc, np.arange(len(offs)))
        self.hash = span_hash(prefix(data, BASE_A), starts, ends, BASE_A)
        n = max(0, len(starts) - window + 1)
        self.grams = rolling_hash(self.hash, gram, BASE_B)
        self.anchor = anchors(self.grams, window - gram + 1)[:n] if n else np.zeros(0, np.int64)
        self.inside = self.doc[:n] == self.doc[window - 1 : window - 1 + n]
        self.window = window

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of every window, from two bases."""
        second = rolling_hash(self.hash, self.window, BASE_B)
        return rolling_hash(self.hash, self.window, BASE_A).view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for lo, _, data, offs in chunks(batch.column(2)):
                w = _Windows(data, offs, window, gram)
                at = w.anchor[w.inside]
                if not len(at):
                    continue
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.grams[at].view(np.int64)), pa.array(ids[lo + doc]), pa.array(tags[lo + doc]), pa.array((at - w.first[doc]).astype(np.int32))], ["gram", "did", "tag", "place"]
                )

    return run


def _window_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            lists = batch.column(3)
            edges, places = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column(2)):
                w = _Windows(data, offs, window, gram)
                if not len(w.anchor):
                    continue
                mine = places[edges[lo] : edges[hi]]
                row = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
                at = w.first[row] + mine
                wanted = np.zeros(len(w.doc), bool)
                wanted[at[at < w.first[row + 1]]] = True
                pick = np.flatnonzero(w.inside & wanted[w.anchor])
                h1, h2 = (h[pick] for h in w.hashes())
                doc = w.doc[pick]
                order = np.lexsort((pick, h2, h1, doc))
                same = (doc[order][1:] == doc[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                again = np.zeros(len(pick), bool)
                again[order[1:][same]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(ids[lo + doc]), pa.array(tags[lo + doc]), pa.array((pick - w.first[doc]).astype(np.int32)), pa.array(again)],
                    ["h1", "h2", "did", "tag", "start", "again"],
                )

    return run


def _cut(window: int, gram: int, names: list[str]):
    """Removes the covered words; a start counts only where the text's window has the hash noted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            edges, packed = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column(1)):
                covered = first = None
                if edges[hi] > edges[lo]:
                    w = _Windows(data, offs, window, gram)
                    first, total = w.first, len(w.doc)
                    mine = packed[edges[lo] : edges[hi]]
                    row = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
                    at = first[row] + (mine >> 32)
                    fits = at + window <= first[row + 1]
                    at, note = at[fits], mine[fits].astype(np.uint32)
                    at = at[w.hashes()[1].view(np.uint32)[at] == note] if len(at) else at
                    step = np.zeros(total + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    covered = np.cumsum(step)[:total] > 0
                whole = data.tobytes()
                kept, n_words, n_removed, spans = [], [], [], []
                for i in range(hi - lo):
                    parts = whole[offs[i] : offs[i + 1]].split()
                    gone = covered[first[i] : first[i + 1]] if covered is not None else None
                    runs = []
                    if gone is not None and gone.any():
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                        runs = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
                        kept.append(b" ".join([p for p, g in zip(parts, gone.tolist()) if not g]).decode())
                    else:
                        kept.append(b" ".join(parts).decode())
                    n_words.append(len(parts))
                    n_removed.append(sum(r["end"] - r["start"] for r in runs))
                    spans.append(runs)
                span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span_type)], names
                )

    return run


def remove_repeated_windows(
    docs: DataFrame, *, window: int = 20, gram: int = 8, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed, spans (maximal runs of removed words, [start, end)).

    A word goes if a window covers it whose words also start earlier: in a document of smaller id,
    or earlier in the same one. Windows are judged on the input. Ids are integers. Null text is
    empty; a null id comes after all others. Rows with the same id (or null ids) count as the same
    document seen in parallel: each is judged against smaller ids and against itself, never
    against the others, so repeated rows have equal results. Texts of under ``window`` words are
    kept. A very long text is held whole by its task, with some 50 bytes for each of its bytes; repeated
    passages of any length are found. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be in 1..window")
    scratch = scratch or Scratch(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("own_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("did"), text_key(text).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # ids may be null or repeated: (did, tag) is one text, so each list has the bound of one text; did alone orders owners
    slim = base.select("did", "tag", "body")

    places = slim.mapInArrow(_anchor_rows(window, gram), "gram long, did long, tag long, place int")
    # read back, both sides of the join are plain shuffles, and Spark can split a hot anchor's rows
    often = scratch.write(places.groupBy("gram").count().where("count > 1").select("gram"))
    wanted = scratch.write(places.join(often, "gram", "left_semi").groupBy("did", "tag").agg(F.collect_set("place").alias("places")))

    rows = slim.join(wanted, ["did", "tag"]).select("did", "tag", "body", "places")
    rows = scratch.write(rows.mapInArrow(_window_rows(window, gram), "h1 long, h2 int, did long, tag long, start int, again boolean"))
    scratch.drop(wanted, often)
    once = rows.where(~F.col("again")).drop("again")
    # a table of its own, so that the shuffle that counts is gone before the one that joins
    owner = scratch.write(once.groupBy("h1", "h2").agg(F.min("did").alias("owner"), F.max("did").alias("last")).where("owner < last").drop("last"))
    gone = once.join(owner, ["h1", "h2"]).where("did > owner").select("did", "tag", "start", "h2")
    gone = gone.unionByName(rows.where("again").select("did", "tag", "start", "h2"))
    note = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("h2").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    spans = scratch.write(gone.groupBy("did", "tag").agg(F.collect_set(note).alias("notes")))
    scratch.drop(rows, owner)

    joined = base.join(spans, ["did", "tag"], "left").select("own_id", "body", F.coalesce("notes", F.array().cast("array<bigint>")).alias("notes"))
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["own_id", "kept_text", "n_words", "n_removed", "spans"]
    out = joined.mapInArrow(_cut(window, gram, names), f"own_id {kind}, kept_text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("own_id", doc_id)
