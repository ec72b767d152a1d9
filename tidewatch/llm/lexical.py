"""Ranked lexical search by bit-sliced Bloom signatures.

One scan of the texts writes blocks of signatures: bit ``b`` of all texts of a block is one slice, and
a (term, level) key sets a few bits of its text for each level of repeats that the term reaches there. It also
counts what the weights need. A query term may be present where all its slices have a bit, at a level
only if at all lower ones too, so presence and repeats are never underestimated. Weighted sums of those
rows bound every text's score from above, each term with the most repeats that its highest level allows.
To get a score that k texts reach, the texts are first ranked by the same sums with each term's weight
times the share of its bits that are no chance, and the best are scored exactly. Every text whose bound does
not fall below that score is scored exactly too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch
from tidewatch.llm.tables import id_key, text_key
from tidewatch.llm.text import BASE_A, chunks, mix, prefix, span_hash, spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, letters and everything beyond ASCII make terms.
IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: A term has level j where it occurs LEVELS[j] times or more; each is about a third above the one before.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, *(round(8 * (4 / 3) ** i) for i in range(1, 67))], np.int64)
_SALTS = mix(np.arange(1, len(LEVELS) + 1, dtype=np.uint64))
#: Bits that a key sets, and bits that a text has for each of its keys: one absent key in 10,000 looks present.
HASHES, BITS = 10, 20
#: A block: texts times the width of a signature, texts; their numbers of keys differ by this factor at most.
BLOCK_BITS, BLOCK_TEXTS, SPREAD = 1 << 24, 1024, 1.5
#: Keys that a task gathers before it cuts them into blocks.
GATHERED = 1 << 20
#: Texts times (query, term) pairs that one step holds.
AT_ONCE = 1 << 21
#: Rows that are few enough to send to all tasks: 16 bytes each.
SEND_ROWS = 1 << 16

SIGNATURES = "dids array<long>, tags array<long>, sizes array<long>, width int, slices binary, terms array<int>, texts array<long>"


def _term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased term, and its text."""
    starts, ends, doc = spans(IN_TERM[data], offs)
    return span_hash(prefix(_LOWER[data], BASE_A), starts, ends, BASE_A), doc


def term_counts(text: str | None) -> Counter:
    return Counter(_TERM.findall((text or "").encode().lower()))


def _places(hashes: np.ndarray, levels: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The bits of each (term, level) key in a signature of ``width`` bits, one array for each of HASHES."""
    h = mix(hashes ^ _SALTS[levels])
    low, step, mask = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64(0xFFFFFFFF)
    for _ in range(HASHES):
        yield ((low * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
        low = (low + step) & mask


def _slices(key_hash: np.ndarray, key_level: np.ndarray, key_text: np.ndarray, many: int, width: int) -> bytes:
    row = -(-many // 8) * 8
    bits = np.zeros(width * row, bool)
    for place in _places(key_hash, key_level, width):
        bits[place * row + key_text] = True
    return np.packbits(bits.reshape(width, row), axis=1, bitorder="little").tobytes()


class _Gathered:
    """Keys of texts until there are enough for blocks."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.hash, self.level, self.text, self.dids, self.tags, self.size = [], [], [], [], [], []
        self.texts, self.keys, self.held = 0, 0, np.zeros(len(self.vocabulary), np.int64)

    def add(self, dids: np.ndarray, tags: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
        hashes, doc = _term_hashes(data, offs)
        size = np.bincount(doc, minlength=len(dids))
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        h, d, tf = h[at], d[at], np.diff(np.append(at, len(h)))
        if len(self.vocabulary):
            where = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            self.held += np.bincount(where[self.vocabulary[where] == h], minlength=len(self.vocabulary))
        # a key for each level that a term reaches
        reach = np.searchsorted(LEVELS, tf, side="right")
        key = np.repeat(np.arange(len(h)), reach)
        self.hash.append(h[key])
        self.level.append((np.arange(len(key)) - np.repeat(np.cumsum(reach) - reach, reach)).astype(np.int8))
        self.text.append((d[key] + self.texts).astype(np.int32))
        for held, new in ((self.dids, dids), (self.tags, tags), (self.size, size)):
            held.append(new)
        self.texts += len(dids)
        self.keys += len(key)

    def blocks(self) -> Iterator[tuple]:
        """Rows of SIGNATURES; the first also says how many of the texts hold each term of the vocabulary."""
        if not self.texts:
            return
        h, level, text = (np.concatenate(x) for x in (self.hash, self.level, self.text))
        dids, tags, size = (np.concatenate(x) for x in (self.dids, self.tags, self.size))
        keys = np.bincount(text, minlength=self.texts)
        starts = np.cumsum(keys) - keys
        by_keys = np.argsort(keys, kind="stable")
        by_keys, ordered = by_keys[np.searchsorted(keys[by_keys], 1) :], np.sort(keys)
        ordered = ordered[np.searchsorted(ordered, 1) :]
        terms, first = np.flatnonzero(self.held), 0
        while first < len(by_keys):
            last = min(int(np.searchsorted(ordered, ordered[first] * SPREAD, side="right")), first + BLOCK_TEXTS)
            last = min(last, max(first + 1, first + BLOCK_BITS // (BITS * int(ordered[last - 1]))))
            width = -(-BITS * int(ordered[last - 1]) // 8) * 8
            own = by_keys[first:last]
            take = np.repeat(starts[own] - (np.cumsum(keys[own]) - keys[own]), keys[own]) + np.arange(keys[own].sum())
            slices = _slices(h[take], level[take], np.repeat(np.arange(len(own)), keys[own]), len(own), width)
            yield dids[own], tags[own], size[own], width, slices, terms if first == 0 else [], self.held[terms] if first == 0 else []
            first = last


def _index(vocabulary: np.ndarray):
    """(did, tag, body) to blocks of signatures."""
    names = [c.split()[0] for c in SIGNATURES.split(", ")]
    kinds = [pa.list_(pa.int64())] * 3 + [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def rows(gathered: _Gathered) -> Iterator[pa.RecordBatch]:
        for row in gathered.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)
        gathered.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(vocabulary)
        for batch in batches:
            dids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column(2), 1 << 20):
                gathered.add(dids[lo:hi], tags[lo:hi], data, offs)
                if gathered.keys >= GATHERED:
                    yield from rows(gathered)
        yield from rows(gathered)

    return run


@dataclass
class _Queries:
    """A block of queries: the terms of each with their repeats, over one sorted vocabulary of hashes."""

    ids: list
    counts: list[Counter]
    vocabulary: np.ndarray
    #: Of all (query, term) pairs, by query: the term's place in the vocabulary, its repeats; where each query begins.
    term: np.ndarray
    repeats: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> _Queries:
        counts = [term_counts(text) for _, text in rows]
        some = [i for i, c in enumerate(counts) if c]
        ids, counts = [rows[i][0] for i in some], [counts[i] for i in some]
        flat = [t for c in counts for t in c]
        blob = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum([len(t) for t in flat]).astype(np.int64) if flat else np.zeros(0, np.int64)
        hashes = span_hash(prefix(blob, BASE_A), np.append(0, ends)[:-1], ends, BASE_A) if flat else np.zeros(0, np.uint64)
        vocabulary, term = np.unique(hashes, return_inverse=True)
        sizes = [len(c) for c in counts]
        return cls(ids, counts, vocabulary, term, np.array([n for c in counts for n in c.values()], np.int64), np.cumsum([0, *sizes])[:-1])


@dataclass
class _Corpus:
    """What scores need to know of all documents: how many have a term, how many terms they have, each term's weight."""

    texts: int
    terms: int
    held: np.ndarray
    weight: np.ndarray

    def length(self, n: np.ndarray | int) -> np.ndarray | int:
        return 100 - 75 + (75 * n * self.texts) // self.terms


def _gain(tf, length):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


def _bounds(block: dict, q: _Queries, corpus: _Corpus, likely: bool = False) -> Iterator[tuple[slice, np.ndarray]]:
    """Some texts of a block and [query, text] for them: bounds that no score exceeds, or with ``likely`` estimates of the scores."""
    sizes = np.asarray(block["sizes"], np.int64)
    slices = np.frombuffer(block["slices"], np.uint8).reshape(block["width"], -1)
    weights = corpus.weight
    if likely:
        chance = (np.unpackbits(slices[:: max(1, len(slices) >> 10)]).mean() * slices.shape[1] * 8 / len(sizes)) ** HASHES
        weights = weights * (corpus.held / np.maximum(corpus.held + chance * corpus.texts, 1e-9))
    step = max(1, AT_ONCE // max(1, len(q.term)) // 8)
    for lo in range(0, slices.shape[1], step):
        part = slice(8 * lo, min(8 * (lo + step), len(sizes)))
        yield part, _sums(slices[:, lo : lo + step], sizes[part], q, corpus, q.repeats * weights[q.term])


def _sums(slices: np.ndarray, size: np.ndarray, q: _Queries, corpus: _Corpus, weights: np.ndarray) -> np.ndarray:
    """[query, text]: for each level that slices report, the weights of the terms there times what the level adds to a gain."""
    length, many = corpus.length(size), len(size)
    out = np.zeros((len(q.ids), many), weights.dtype)
    alive, present, below = np.arange(len(q.vocabulary)), None, np.zeros(many, np.int64)
    queries, pairs, begin = np.arange(len(q.ids)), np.arange(len(q.term)), q.begin
    for level in range(len(LEVELS)):
        for place in _places(q.vocabulary[alive], np.full(len(alive), level), len(slices)):
            present = slices[place] if present is None else present & slices[place]
        keep = present.any(axis=1)
        alive, present = alive[keep], present[keep]
        if not len(alive):
            break
        row = np.full(len(q.vocabulary), -1)
        row[alive] = np.arange(len(alive))
        held = row[q.term[pairs]] >= 0
        owner = np.searchsorted(begin, np.flatnonzero(held), side="right") - 1
        pairs = pairs[held]
        which, starts = np.unique(owner, return_index=True)
        rows = np.unpackbits(present, axis=1, count=many, bitorder="little")
        sums = np.add.reduceat(rows[row[q.term[pairs]]] * weights[pairs, None], starts, axis=0)
        most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.iinfo(np.int32).max
        gain = _gain(np.minimum(most, size), length)
        queries = queries[which]
        out[queries] += sums * (gain - below)
        below, begin = gain, starts
    return out


def _each(q: _Queries, corpus: _Corpus, choose, likely: bool = False):
    """Blocks of signatures to (query, did, tag, bound) of the pairs that ``choose`` takes: it sees all blocks of a task, and may hold back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for i in range(batch.num_rows):
                    (block,) = batch.slice(i, 1).to_pylist()
                    dids, tags = np.asarray(block["dids"], np.int64), np.asarray(block["tags"], np.int64)
                    for part, bounds in _bounds(block, q, corpus, likely):
                        yield dids[part], tags[part], bounds

        for query, did, tag, bound in choose(blocks()):
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(did, pa.int64()), pa.array(tag, pa.int64()), pa.array(bound.astype(np.int64), pa.int64())], ["query", "did", "tag", "bound"])

    return run


def _highest(k: int):
    """The k pairs of highest value a query and task."""

    def choose(blocks):
        best = None
        for did, tag, bound in blocks:
            at = np.argpartition(-bound, k - 1, axis=1)[:, :k] if bound.shape[1] > k else np.broadcast_to(np.arange(bound.shape[1]), bound.shape)
            new = [np.take_along_axis(bound, at, axis=1), did[at], tag[at]]
            best = new if best is None else [np.concatenate(x, axis=1) for x in zip(best, new)]
            if best[0].shape[1] > k:
                at = np.argpartition(-best[0], k - 1, axis=1)[:, :k]
                best = [np.take_along_axis(x, at, axis=1) for x in best]
        if best is not None:
            query, at = np.nonzero(best[0] > 0)
            yield query, best[1][query, at], best[2][query, at], best[0][query, at]

    return choose


def _not_excluded(least: np.ndarray, did_of: np.ndarray, tag_of: np.ndarray):
    """Pairs whose bound is above the query's ``least``, or equal with a key that would not come after the one that reached it."""

    def choose(blocks):
        for did, tag, bound in blocks:
            tie = (did < did_of[:, None]) | ((did == did_of[:, None]) & (tag <= tag_of[:, None]))
            query, at = np.nonzero((bound > 0) & ((bound > least[:, None]) | ((bound == least[:, None]) & tie)))
            if len(query):
                yield query, did[at], tag[at], bound[query, at]

    return choose


def _exact(q: _Queries, corpus: _Corpus):
    """(own_id, did, tag, body, queries) to (query, own_id, did, tag, score)."""
    place = {}
    for term, i in zip((t for c in q.counts for t in c), q.term.tolist()):
        place[term] = int(corpus.weight[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, queries, scores = [], [], []
            for i in range(batch.num_rows):
                counts = term_counts(batch.column(3)[i].as_py())
                length = corpus.length(sum(counts.values()))
                gains = {}
                for x in batch.column(4)[i].as_py():
                    score = 0
                    for term, n in q.counts[x].items():
                        if tf := counts.get(term):
                            if term not in gains:
                                gains[term] = place[term] * _gain(tf, length)
                            score += n * gains[term]
                    if score > 0:
                        rows.append(i)
                        queries.append(x)
                        scores.append(score)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int32()), *(batch.column(j).take(at) for j in range(3)), pa.array(scores, pa.int64())], ["query", "own_id", "did", "tag", "score"])

    return run


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block: int = 2_000,
    block_bytes: int = 1 << 22,
    scratch: Scratch | None = None,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``queries``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With N documents
    that have a term, L terms in all of them, n in one, a term's weight is floor(1000 ln((2N + 2) / (2 df + 1)))
    and its share weight * (10**9 tf div (1000 tf + 8 m)) with m = 100 - 75 + (75 n N) div L; a query's repeats count.
    Equal scores are ranked by ascending id, a null id last, then by a hash of the text.

    Null and empty texts have no terms and are never found, nor do such queries find any. Each of several rows
    with the same id and text is a document of its own and takes a rank; so do rows with null ids. Queries are
    read in blocks of about ``block`` rows and ``block_bytes`` of text, with a scan of the documents each; rows
    with the same or a null item id are queries of their own. A very long text is held whole by its task.
    An empty table on either side gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("own_id"), id_key(doc_id).alias("did"), text_key(text).alias("tag"), F.col(text).alias("body"))
    asked = queries.select(F.col(item_id).alias("qid"), F.col(item_text).alias("body")).where("body IS NOT NULL")
    many, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    blocks = 1 if many <= block and size <= block_bytes else math.ceil(2 * max(many / block, size / block_bytes))
    kind = queries.schema[item_id].dataType.simpleString()
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid", "body"), F.lit(blocks)) == i)
        rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # one block of queries
        found = _search(slim, _Queries.of(rows), f"query int, qid {kind}", k, scratch) if rows else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, `{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score long")
    return out.withColumnRenamed("own_id", doc_id).withColumnRenamed("qid", "item_id").select("item_id", "rank", doc_id, "score")


def _search(slim: DataFrame, q: _Queries, kind: str, k: int, scratch: Scratch) -> DataFrame | None:
    index = scratch.write(slim.select("did", "tag", "body").mapInArrow(_index(q.vocabulary), SIGNATURES))
    texts, terms = index.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not terms or not len(q.vocabulary):
        return None
    held = np.zeros(len(q.vocabulary), np.int64)
    pairs = index.where("size(terms) > 0").select(F.explode(F.arrays_zip("terms", "texts")).alias("x"))
    for r in pairs.groupBy("x.terms").agg(F.sum("x.texts")).collect():  # at most one row a term of the block of queries
        held[r[0]] = r[1]
    corpus = _Corpus(texts, terms, held, np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(n) + 1))) for n in held], np.int64))
    schema = "query int, did long, tag long, bound long"

    top = Window.partitionBy("query").orderBy(F.desc("bound"), "did", "tag")
    tries = 2 * k  # estimates may be wrong
    probes = index.mapInArrow(_each(q, corpus, _highest(tries), likely=True), schema).withColumn("place", F.row_number().over(top)).where(F.col("place") <= tries)
    tried = _scored(slim, scratch.write(probes.select("query", "did", "tag")), q, corpus, scratch)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "did", "tag")
    reached = tried.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
    least, did_of, tag_of = np.zeros(len(q.ids), np.int64), np.zeros(len(q.ids), np.int64), np.zeros(len(q.ids), np.int64)
    for r in reached.select("query", "score", "did", "tag").collect():  # at most one row a query of the block
        least[r[0]], did_of[r[0]], tag_of[r[0]] = r[1:]

    wanted = scratch.write(index.mapInArrow(_each(q, corpus, _not_excluded(least, did_of, tag_of)), schema).select("query", "did", "tag"))
    scratch.drop(index)
    scores = _scored(slim, wanted, q, corpus, scratch)
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = slim.sparkSession.createDataFrame([(i, x) for i, x in enumerate(q.ids)], kind)
    return ranked.join(names, "query").select("qid", "rank", "own_id", "score")


def _scored(slim: DataFrame, pairs: DataFrame, q: _Queries, corpus: _Corpus, scratch: Scratch) -> DataFrame:
    """Written exact scores of the (query, did, tag) pairs, for each document with that key."""
    by_key = scratch.write(pairs.groupBy("did", "tag").agg(F.collect_set("query").alias("queries")))
    keys = by_key.select("did", "tag")
    # few keys are sent to the texts, so that only theirs move; else both sides are dealt by key
    near = slim.join(F.broadcast(keys), ["did", "tag"], "left_semi") if keys.count() <= SEND_ROWS else slim
    rows = near.join(by_key, ["did", "tag"]).select("own_id", "did", "tag", "body", "queries")
    kind = slim.schema["own_id"].dataType.simpleString()
    return scratch.write(rows.mapInArrow(_exact(q, corpus), f"query int, own_id {kind}, did long, tag long, score long"))
