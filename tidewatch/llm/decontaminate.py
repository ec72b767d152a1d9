"""Benchmark decontamination by SimHash windows of item size.

For each benchmark item, every window of a text with as many words as the item is a candidate as
soon as it shares one word shingle with it; a window without any has similarity 0. The window gets a
SimHash of 256 bits, in which the second, third, ... of equal shingles count as shingles of their own:
so the weighted similarity of two bags is the plain one of two sets, which is what the radius goes by.
A window's bit counts follow from those of the one before, less one shingle and plus one. A multi-index lists the items within ``radius`` bits:
of 32 blocks of 8 bits, at most ``radius // 3`` can differ in three bits or more, so all others
differ in at most two, and tables by block value say which items are that near. Listed items within
the radius are verified by the exact weighted Jaccard similarity of their shingles, repeats counted.

At a similarity of 0.8 about 39 of 256 bits differ, with a standard deviation of 5.7, whatever repeats; the
default radius lies four of those above, and unrelated fingerprints eight beyond it. That takes the bits to be
independent: a window at just 0.8 is missed about once in thirty thousand.

All shingles of all items are searched once for a chunk of texts, and only the hits are dealt to the
items' groups (by word count). So text without a known shingle costs the same for any number of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.similar import bit_radius
from tidewatch.llm.text import BASE_A, BASE_B, chunks, mix, prefix, rolling_hash, span_hash, words

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

WORDS = 4
_SALTS = np.arange(WORDS, dtype=np.uint64) << np.uint64(60)
BLOCKS = WORDS * 8
#: Bits that may differ in a block of 8 for its value to count as near.
NEAR_BITS = 2
#: Places of windows times bits, or windows times items, that one step holds.
AT_ONCE = 1 << 22
#: A group of more items is cut, so that its tables of near items stay under 16 MB.
GROUP_ITEMS = 2048


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and its text."""
    starts, ends, doc = words(data, offs)
    return span_hash(prefix(_LOWER[data], BASE_A), starts, ends, BASE_A), doc


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Rows of WORDS * 64 independent bits of each hash."""
    wide = np.stack([mix(hashes ^ salt) for salt in _SALTS], axis=1)
    return np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")


def _simhash(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS bytes."""
    return np.packbits(counts * 2 > total[:, None], axis=1, bitorder="little")


#: Added to a shingle's hash for each equal one before it.
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def _numbered(grams: np.ndarray) -> np.ndarray:
    """Hashes in which equal grams differ, by how many equal ones come before them."""
    order = np.argsort(grams, kind="stable")
    g, place = grams[order], np.arange(len(grams))
    first = np.maximum.accumulate(np.where(np.concatenate((np.ones(min(len(g), 1), bool), g[1:] != g[:-1])), place, 0))
    out = np.empty_like(grams)
    out[order] = g + (place - first).astype(np.uint64) * _AGAIN
    return out


def window_prints(grams: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of ``size`` grams from each of the ascending starts; neighbours of one text have the same size.

    When a window moves on by one, its last copy of the gram that leaves goes, and the gram that comes
    counts as one more than the copies left. So each move is two events, and a first window one a gram.
    """
    if not len(start):
        return np.zeros((0, BLOCKS), np.uint8)
    moved = np.concatenate(([False], (start[1:] == start[:-1] + 1) & (size[1:] == size[:-1])))
    lead = np.flatnonzero(~moved)
    length = np.diff(np.append(lead, len(start)))
    a0, m = start[lead], size[lead]
    events = m + 2 * (length - 1)
    base = np.cumsum(events) - events
    run = np.repeat(np.arange(len(lead)), events)
    j = np.arange(len(run)) - base[run]
    step, opening = np.maximum(j - m[run], 0) // 2, j < m[run]
    leaves = ~opening & ((j - m[run]) % 2 == 0)
    place = np.where(opening, a0[run] + j, a0[run] + step + np.where(leaves, 0, m[run]))
    # copies are counted from ``low`` to ``high``
    low = np.where(opening, a0[run], a0[run] + step + np.where(leaves, 0, 1))
    high = np.where(leaves, place + m[run] - 1, place)
    lo, hi = int(start[0]), int((start + size).max())
    _, group = np.unique(grams[lo:hi], return_inverse=True)
    keys = np.sort(group * np.int64(hi - lo + 1) + np.arange(hi - lo))
    own = group[place - lo] * np.int64(hi - lo + 1)
    copies = np.searchsorted(keys, own + (high - lo), side="right") - np.searchsorted(keys, own + (low - lo), side="left")
    bits = _bits(grams[place] + (copies - 1).astype(np.uint64) * _AGAIN).astype(np.int8)
    bits[leaves] *= -1
    sums = np.zeros((len(run) + 1, WORDS * 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    at = np.repeat(base + m, length) + 2 * (np.arange(len(start)) - np.repeat(lead, length))
    return _simhash(sums[at] - sums[np.repeat(base, length)], size)


@dataclass
class _Group:
    """Items of one word count: their shingles, with repeats, and fingerprints."""

    n: int
    k: int
    ids: list[int | None] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    prints: np.ndarray | None = None

    def close(self) -> None:
        self.prints = np.concatenate([_simhash(_bits(_numbered(s)).sum(axis=0, dtype=np.int64)[None], np.array([len(s)])) for s in self.shingles])

    def tables(self) -> np.ndarray:
        """[block, value, item]: whether the item's block is within NEAR_BITS of the value."""
        value = np.arange(256, dtype=np.uint8)[None, :, None]
        return _POPCOUNT[value ^ self.prints.T[:, None, :]] <= NEAR_BITS


@dataclass
class _Index:
    """All groups of one shingle length, and which of them hold each known shingle."""

    k: int
    groups: list[_Group]
    known: np.ndarray
    edges: np.ndarray
    owner: np.ndarray
    #: By the top 20 bits of a hash: whether any known one begins so.
    begins: np.ndarray

    @classmethod
    def of(cls, k: int, groups: list[_Group]) -> _Index:
        held = [np.unique(np.concatenate(g.shingles)) for g in groups]
        shingle = np.concatenate(held)
        group = np.repeat(np.arange(len(groups)), [len(h) for h in held])
        order = np.lexsort((group, shingle))
        known, first = np.unique(shingle[order], return_index=True)
        begins = np.zeros(1 << 20, bool)
        begins[known >> np.uint64(44)] = True
        return cls(k, groups, known, np.append(first, len(shingle)), group[order], begins)

    def hits(self, grams: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(group, ascending places of its shingles) for all groups that have any; no place spans two texts."""
        maybe = np.flatnonzero(self.begins[grams >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        found = (self.known[at] == grams[maybe]) & (doc[maybe] == doc[maybe + self.k - 1])
        place, at = maybe[found], at[found]
        if not len(place):
            return
        many = self.edges[at + 1] - self.edges[at]
        spread = np.repeat(self.edges[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        group, place = self.owner[spread], np.repeat(place, many)
        order = np.argsort(group, kind="stable")
        group, place = group[order], place[order]
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(group[lo]), place[lo:hi]


def _prepare(items: list[tuple[int | None, str]], shingle: int) -> list[_Index]:
    """An index for each shingle length: the given one, or an item's whole length if it has fewer words."""
    groups: dict[tuple[int, int], list[_Group]] = {}
    for item_id, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = _word_hashes(raw, np.array([0, len(raw)]))
        if not len(hashes):
            continue
        n, k = len(hashes), min(shingle, len(hashes))
        same = groups.setdefault((k, n), [])
        if not same or len(same[-1].ids) >= GROUP_ITEMS:
            same.append(_Group(n, k))
        same[-1].ids.append(item_id)
        same[-1].shingles.append(rolling_hash(hashes, k, BASE_B))
    by_k: dict[int, list[_Group]] = {}
    for (k, _), same in groups.items():
        for g in same:
            g.close()
        by_k.setdefault(k, []).extend(same)
    return [_Index.of(k, g) for k, g in by_k.items()]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima; 0 for two empty bags."""
    low = sum(min(v, b[x]) for x, v in a.items() if x in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def _matches(
    grams: np.ndarray, hits: np.ndarray, first: np.ndarray, counts: np.ndarray, doc: np.ndarray, g: _Group, near: np.ndarray, radius: int, least: float
) -> Iterator[tuple[int, int | None, float, int]]:
    """(text, item id, similarity, first word) of all windows with a hit that pass, for the items of one group."""
    owner = doc[hits]
    size = np.minimum(counts[owner], g.n)  # a text shorter than the item is one window
    low = np.maximum(hits - (size - g.k), first[owner])
    high = np.minimum(hits, first[owner] + counts[owner] - size)
    low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)  # windows of an earlier hit once
    spread = np.maximum(high - low + 1, 0)
    start = np.repeat(low - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
    shingles = np.minimum(counts[doc[start]], g.n) - g.k + 1
    must = BLOCKS - radius // (NEAR_BITS + 1)
    # about so many windows and events at once; a window that does not follow the one before has an event a shingle
    load = np.cumsum(np.where(np.concatenate(([True], start[1:] != start[:-1] + 1)), shingles, 2) + len(g.ids) // (WORDS * 64)) // (AT_ONCE // (WORDS * 64))
    cuts = np.flatnonzero(np.concatenate(([True], load[1:] != load[:-1], [True])))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        s, m = start[lo:hi], shingles[lo:hi]
        prints = window_prints(grams, s, m)
        agree = np.zeros((len(s), len(g.ids)), np.uint8)
        for b in range(BLOCKS):
            agree += near[b][prints[:, b]]
        w, i = np.nonzero(agree >= must)
        gap = _POPCOUNT[prints[w] ^ g.prints[i]].sum(axis=1)
        for a, b in zip(w[gap <= radius].tolist(), i[gap <= radius].tolist()):
            j = int(s[a])
            value = weighted_jaccard(Counter(grams[j : j + int(m[a])].tolist()), Counter(g.shingles[b].tolist()))
            if value >= least:
                yield int(doc[j]), g.ids[b], value, j - int(first[doc[j]])


def _scan(indexes: list[_Index], radius: int, least: float, cache: int = 1 << 26):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[tuple[int, int], np.ndarray] = {}  # tables of groups met so far, up to ``cache`` bytes

        def tables(k: int, at: int, g: _Group) -> np.ndarray:
            if (k, at) not in near:
                if sum(t.nbytes for t in near.values()) > cache:
                    near.clear()
                near[k, at] = g.tables()
            return near[k, at]

        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                hashes, doc = _word_hashes(data, offs)
                first = np.searchsorted(doc, np.arange(hi - lo))
                counts = np.bincount(doc, minlength=hi - lo)
                best: dict[tuple[int, int | None], tuple[float, int]] = {}
                for index in indexes:
                    grams = rolling_hash(hashes, index.k, BASE_B)
                    for at, hits in index.hits(grams, doc):
                        g = index.groups[at]
                        for d, item, value, start in _matches(grams, hits, first, counts, doc, g, tables(index.k, at, g), radius, least):
                            if (value, -start) > best.get((d, item), (-1.0, 0)):
                                best[d, item] = (value, -start)
                rows = [(lo + d, item, value, -neg) for (d, item), (value, neg) in best.items()]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())],
                    ["own_id", "item_id", "similarity", "start"],
                )

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int | None = None,
    block: int = 20_000,
    block_bytes: int = 1 << 24,
) -> DataFrame:
    """doc_id, item_id, similarity, start for each document and item of which some window reaches ``similarity``.

    ``start`` is the first word of the best window (the earliest of equals). ``radius`` is in bits of
    256; by default four standard deviations above what ``similarity`` gives. Items are read in blocks of about
    ``block`` of them and ``block_bytes`` of their text, one scan of the documents a block, so that what each task
    holds has a bound; their ids are integers. Items with a null id match like others, under a null item_id;
    within a block, items with the same id (or null ids) give one row a document, that of the best window. Words are lower-cased (A-Z). Null or empty texts,
    and items without words, match nothing. A text shorter than an item is compared as a whole; a very long
    text is read whole, its windows in steps of bounded memory. Null
    document ids are kept as they are, repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored.
    """
    radius = bit_radius(similarity, WORDS * 64, margin=4.0) if radius is None else radius
    slim = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("body"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"own_id {kind}, item_id long, similarity double, start int"
    known = items.where(F.col(text).isNotNull())
    many, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    # twice as many blocks as would do if hashes dealt evenly
    blocks = 1 if many <= block and size <= block_bytes else math.ceil(2 * max(many / block, size / block_bytes))
    out = None
    for i in range(blocks):
        part = known.where(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == i)
        rows = {(None if r[0] is None else int(r[0]), r[1]) for r in part.select(item_id, text).collect()}  # one block of items
        indexes = _prepare(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), shingle)
        found = slim.mapInArrow(_scan(indexes, radius, similarity), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("own_id", doc_id)
