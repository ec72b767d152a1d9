"""Training-order materialisation of token ids.

Texts become fixed-length sequences of token ids. A keyed Feistel permutation assigns every
sequence its global slot: index i of n goes through a few rounds on an even number of bits, again
and again while it lands at n or above (cycle-walking). So slot and index follow from each other
without a shuffle order being stored, and training can stop and resume at any slot. Range
partitions by slot hold fixed-stride records: pages in which record r starts at byte r times the stride,
to be read in sequence or by offset.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.scratch import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the vocabulary's free id, set after each text.
END_OF_TEXT = 50256
#: More shards than this share tasks, of up to so many bytes of token ids each.
MANY_TASKS, TASK_BYTES = 10_000, 1 << 27
_loaded: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The encoding at ``path``, loaded once a worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _sequences(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, encoding = ["own_id", "seq_no", "n_tokens", "tokens"], tokenizer(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                row, seq_no, sizes, body = [], [], [], []
                for i, value in enumerate(batch.column(1)):
                    ids = np.array([*encoding.encode_ordinary(value.as_py() or ""), END_OF_TEXT], np.uint16)
                    for k, at in enumerate(range(0, len(ids), length)):
                        part = ids[at : at + length]
                        row.append(i)
                        seq_no.append(k)
                        sizes.append(len(part))
                        body.append(part.tobytes().ljust(length * 2, b"\0"))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(seq_no, pa.int32()), pa.array(sizes, pa.int32()), pa.array(body, pa.binary())], names)

    return run


class Feistel:
    """A keyed permutation of 0..n-1."""

    ROUNDS = 6

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        rng = np.random.default_rng(key)
        self.keys = rng.integers(0, 1 << 63, self.ROUNDS, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = np.array(x, dtype=np.uint64)
        if self.n < 2:
            return out.astype(np.int64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = step(out[todo])
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        def step(x):
            left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
            for k in self.keys:
                left, right = right, left ^ self._round(right, k)
            return (left << np.uint64(self.half)) | right

        return self._walk(index, step)

    def index(self, slot: np.ndarray) -> np.ndarray:
        def step(x):
            left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
            for k in self.keys[::-1]:
                left, right = right ^ self._round(left, k), left
            return (left << np.uint64(self.half)) | right

        return self._walk(slot, step)


def training_order(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer_path: str = TOKENIZER,
    length: int = 1024,
    per_shard: int = 8192,
    key: int = 42,
    scratch: Scratch | None = None,
) -> DataFrame:
    """slot, shard, position, doc_id, seq_no, n_tokens, tokens: one row a sequence, in slot order within a partition.

    Each text gives its ids and an end mark, cut into sequences of ``length``; ``tokens`` holds
    ``length`` little-endian 16-bit ids, zeros after ``n_tokens``. Slots are 0..n-1; shard is
    slot // per_shard and position the rest. The index that is permuted is the row's place in the
    written table of sequences (its files in order of their numbers), so it depends on how ``docs``
    is split into files, not on timing. Null and empty texts give one sequence with the end mark
    only; a very long text gives many sequences, equal texts equal ones. Null ids and repeated rows
    are kept. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("body"))
    table = scratch.write(slim.mapInArrow(_sequences(tokenizer_path, length), f"own_id {kind}, seq_no int, n_tokens int, tokens binary"))
    # a task may write several files: its number, then the file's number within it
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long")
    file = F.shiftleft(number(r"^part-(\d+)-"), 32).bitwiseOR(number(r"-c(\d+)\."))
    placed = table.select("*", file.alias("file"), F.col("_metadata.row_index").alias("row"))
    files = sorted((r["file"], r["count"]) for r in placed.groupBy("file").count().collect())  # one row a file
    names = np.array([f for f, _ in files], np.int64)
    before = np.cumsum([0] + [c for _, c in files])
    n = int(before[-1])
    permutation = Feistel(n, key)

    @F.pandas_udf("long")
    def slot_of(file: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(permutation.slot(before[np.searchsorted(names, file.to_numpy())] + row.to_numpy()))

    shards = max(1, -(-n // per_shard))
    # a task a shard, or more than one shard of up to TASK_BYTES together where there are very many
    tasks = shards if shards <= MANY_TASKS else max(MANY_TASKS, -(-n * length * 2 // TASK_BYTES))
    each = -(-shards // tasks)
    out = placed.withColumn("slot", slot_of("file", "row")).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    out = out.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard", "slot")
    return out.select("slot", "shard", (F.col("slot") % per_shard).cast("int").alias("position"), F.col("own_id").alias(doc_id), "seq_no", "n_tokens", "tokens")


#: Records of one page: a row of the written table, which holds them one after another.
PAGE = 512


def _pages(per_shard: int, page: int, kind: pa.DataType):
    """Records in slot order to pages; a page ends with its shard."""
    names = ["shard", "first_slot", "records", "crc32", "payload", "doc_ids", "seq_nos", "sizes"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            slots, tokens, ids, seq_nos, sizes = zip(*held)
            held.clear()
            blob = b"".join(tokens)
            row = [slots[0] // per_shard, slots[0], len(slots), zlib.crc32(blob), blob, list(ids), list(seq_nos), list(sizes)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (row[0] // per_shard != held[0][0] // per_shard or row[0] != held[-1][0] + 1 or len(held) >= page):
                    yield close()
                held.append(row)
        if held:
            yield close()

    return run


def shard_pages(ordered: DataFrame, per_shard: int, page: int = PAGE) -> DataFrame:
    """shard, first_slot, records, crc32, payload and, by record, doc_ids, seq_nos, sizes: record r of a page is at byte r times the stride of its payload."""
    kind = ordered.schema.fields[3].dataType
    rows = ordered.select("slot", "tokens", F.col(ordered.columns[3]).alias("own_id"), "seq_no", "n_tokens")
    schema = f"shard int, first_slot long, records int, crc32 long, payload binary, doc_ids array<{kind.simpleString()}>, seq_nos array<int>, sizes array<int>"
    return rows.mapInArrow(_pages(per_shard, page, to_arrow_type(kind)), schema)


def read_records(pages: DataFrame, per_shard: int, doc_id: str = "doc_id") -> DataFrame:
    """The rows that ``shard_pages`` was made of; each record is read at its place in the payload."""
    # a lambda's variable is a reference, where each mention of the column would copy the whole payload
    record = lambda p, x: F.struct(
        (F.col("first_slot") + x).alias("slot"), F.get("doc_ids", x).alias("own_id"), F.get("seq_nos", x).alias("seq_no"), F.get("sizes", x).alias("n_tokens"),
        F.substring(p, x * F.floor(F.length(p) / F.col("records")).cast("int") + 1, F.floor(F.length(p) / F.col("records")).cast("int")).alias("tokens"),
    )
    places = F.sequence(F.lit(0), F.col("records") - 1)
    found = pages.select("shard", F.inline(F.get(F.transform(F.array("payload"), lambda p: F.transform(places, lambda x: record(p, x))), F.lit(0))))
    return found.select("slot", "shard", (F.col("slot") % per_shard).cast("int").alias("position"), F.col("own_id").alias(doc_id), "seq_no", "n_tokens", "tokens")


def write_shards(ordered: DataFrame, path: str, per_shard: int, page: int = PAGE) -> None:
    """The pages of all shards, in slot order within a file; a shard is in one file."""
    shard_pages(ordered, per_shard, page).write.option("compression", "zstd").parquet(path)


def resume(spark: SparkSession, path: str, slot: int, per_shard: int, doc_id: str = "doc_id") -> DataFrame:
    """What ``write_shards`` wrote, from ``slot`` on; row groups of earlier shards are not read."""
    pages = spark.read.parquet(path).where((F.col("shard") >= slot // per_shard) & (F.col("first_slot") + F.col("records") > slot))
    return read_records(pages, per_shard, doc_id).where(F.col("slot") >= slot)


def written_order(docs: DataFrame, *, doc_id: str = "doc_id", per_shard: int = 8192, scratch: Scratch | None = None, **options) -> DataFrame:
    """``training_order`` written as fixed-stride shards in the shared folder and read back by offset."""
    scratch = scratch or Scratch(docs.sparkSession)
    ordered = training_order(docs, doc_id=doc_id, per_shard=per_shard, scratch=scratch, **options)
    path = scratch.place()
    with scratch.tidy():
        write_shards(ordered, path, per_shard)
    pages = docs.sparkSession.read.schema(shard_pages(ordered, per_shard).schema).parquet(path)
    return read_records(pages, per_shard, doc_id)
