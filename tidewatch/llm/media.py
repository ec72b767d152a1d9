"""Lossless media columns: grey 8-bit PNG images in a binary column, and a perceptual hash.

The writer filters scan lines, deflates them and frames them in chunks with CRC-32. The reader
checks the signature, every chunk's checksum, the header and the length, and undoes all five
filters. Features are low-frequency terms of a two-dimensional cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HASH_SIDE, _LOW = 32, 8
_i = np.arange(_HASH_SIDE)
#: The first rows of an orthonormal cosine transform.
_COSINE = np.sqrt(2 / _HASH_SIDE) * np.cos(np.pi * (2 * _i[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _HASH_SIDE))
_COSINE[0] /= np.sqrt(2)


def payload(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the image width."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A grey 8-bit PNG of a (height, width) array. The line filter (none, left or above) with the smallest sum of differences is used for the whole image."""
    height, width = samples.shape
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    kinds = (samples, left, above)
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in kinds]
    best = cost.index(min(cost))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the filters of (height, 1 + width) lines; runs of lines with one filter go together."""
    height, width = lines.shape[0], lines.shape[1] - 1
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), height]
    for lo, hi in zip(edges, edges[1:]):
        kind = kinds[lo]
        block = out[lo:hi]
        if kind == 1:
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == 2:
            if lo:
                block[0] += out[lo - 1]
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind in (3, 4):
            for y in range(lo, hi):
                up = out[y - 1].tolist() if y else [0] * width
                line, a, c = out[y].tolist(), 0, 0
                for x, b in enumerate(up):
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if da <= db and da <= dc else b if db <= dc else c
                    a, c = (line[x] + guess) & 255, b
                    line[x] = a
                out[y] = line
        elif kind:
            raise ValueError(f"unknown line filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG; ValueError on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) != size or struct.unpack(">I", data[at + 8 + size : at + 12 + size].rjust(4, b"\0"))[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("cut off")
    if head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only grey 8-bit images without interlace")
    raw = zlib.decompress(b"".join(body))
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong length")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: signs of the 63 lowest frequencies (and 0 for the mean) against their median.

    The image is first averaged to 32 x 32 cells; sides under 32 repeat samples.
    """
    height, width = samples.shape
    area = np.zeros((height + 1, width + 1))
    area[1:, 1:] = samples.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    y0, x0 = np.arange(_HASH_SIDE) * height // _HASH_SIDE, np.arange(_HASH_SIDE) * width // _HASH_SIDE
    y1 = np.maximum(y0 + 1, (np.arange(_HASH_SIDE) + 1) * height // _HASH_SIDE)
    x1 = np.maximum(x0 + 1, (np.arange(_HASH_SIDE) + 1) * width // _HASH_SIDE)
    cells = area[y1][:, x1] - area[y0][:, x1] - area[y1][:, x0] + area[y0][:, x0]
    cells /= (y1 - y0)[:, None] * (x1 - x0)[None, :]
    # Rounded, so that the order of floating-point sums cannot flip a sign.
    low = np.round(_COSINE @ cells @ _COSINE.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def media_columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each whole text as a PNG, reads it back and describes both.

    doc_id, n_bytes (UTF-8, null text: 0), payload_bytes, payload_sha256 and tail_crc32 (of the bytes
    read back), media_bytes, media_sha256, feature, and with ``with_media`` the image in ``media``.
    One row for each input row, in no order; no shuffle. Empty text is 64 zero bytes. Equal texts
    give equal values. Repeated rows and null ids are kept. Other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema += ", media binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 7 + with_media]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(lo, 1000), {n: [] for n in names}
                for value in batch.column(1):
                    raw = (value.as_py() or "").encode()
                    media = write_png(np.frombuffer(payload(raw), np.uint8).reshape(-1, WIDTH))
                    samples = read_png(media)
                    back = samples.tobytes()
                    row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples), media)
                    for n, v in zip(names, row):
                        out[n].append(v)
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], t) for n, t in zip(names, types))], [doc_id, *names])

    return docs.select(doc_id, text).mapInArrow(run, schema)
