"""Array helpers for whole texts inside tasks: UTF-8 buffers, words, polynomial hashes, window minima.

A batch of texts is one byte array with offsets, so that each step is a few numpy calls for many
texts. All functions see whole texts; long batches are cut between texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of bytes other than these.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; an odd base has an inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        v = values.astype(np.uint64)
        v += np.uint64(1)
        v *= powers(base, len(values) + 1)[0][: len(values)]
        np.cumsum(v, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each span [start, end) of what ``prefix`` summed."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts])


def rolling_hash(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp: hash of each run of ``width`` values, in one pass of prefix sums."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values, base)
    return mix((sums[width:] - sums[:n]) * powers(base, len(sums))[1][:n])


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: running minima forwards and backwards within blocks."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    if width == 1:
        return v.copy()
    blocks = -(-len(v) // width)
    grid = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    grid[: len(v)] = v
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: Low bits of a packed value that hold its place; the rest is hash. Leftmost wins among equal hashes.
PLACE_BITS = 26


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of its smallest hash, leftmost among equals.

    The place follows from the run's content alone, so equal runs have their anchor at the same
    distance from their start.
    """
    n, step = len(grams), (1 << PLACE_BITS) - width + 1
    if n > 1 << PLACE_BITS:  # more than places have bits for: runs of each stretch in turn
        return np.concatenate([anchors(grams[at : at + step + width - 1], width) + at for at in range(0, n - width + 1, step)])
    keep = np.uint64(((1 << 64) - 1) ^ ((1 << PLACE_BITS) - 1))
    packed = (grams & keep) | np.arange(n, dtype=np.uint64)
    return (window_minima(packed, width) & ~keep).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def pieces(column: pa.Array, limit: int, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """As ``chunks``, but a text of over ``limit`` bytes comes alone in pieces of ``limit`` bytes and ``overlap`` bytes of the next; last, the piece's place in its text."""
    for lo, hi, data, offs in chunks(column, limit):
        if hi - lo > 1 or len(data) <= limit + overlap:
            yield lo, hi, data, offs, 0
            continue
        for at in range(0, len(data) - overlap, limit):
            part = data[at : at + limit + overlap]
            yield lo, hi, part, np.array([0, len(part)]), at


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and text index of each run of ``inside``; no run spans two texts."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    opens, closes = np.ones(n, bool), np.ones(n, bool)
    opens[1:] = ~inside[:-1]
    closes[:-1] = ~inside[1:]
    first, last = offs[:-1], offs[1:] - 1
    opens[first[first < n]] = True
    closes[last[last >= 0]] = True
    starts = np.flatnonzero(inside & opens)
    ends = np.flatnonzero(inside & closes) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and text index of each word; no word spans two texts."""
    return spans(~IS_SPACE[data], offs)
