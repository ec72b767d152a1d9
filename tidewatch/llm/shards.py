"""Uniform shuffle into shards of exact size, in DataFrame functions only.

A uniform permutation of all rows decides how many rows each partition sends to each shard; those
counts alone follow a multivariate hypergeometric law. So the counts are drawn first (a matrix of
partitions by shards, from the partitions' row counts), each partition is permuted on its own and
cut at its counts, rows are exchanged, and each shard is permuted again. No step sorts all rows.

Partitions are slices of a row hash, not Spark's own partitions, so that the result does not
depend on how the table was split into files.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken from good + bad are good: exact inversion, outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows each partition sends to each shard: row sums are ``counts``, column sums ``shard_sizes``."""
    if sum(counts) != sum(shard_sizes):
        raise ValueError("counts and shard sizes differ in total")
    rng, room, matrix = random.Random(seed), list(shard_sizes), []
    for n in counts:
        row, left, others = [], n, sum(room)
        for s, free in enumerate(room):
            others -= free
            x = _hypergeometric(rng, free, others, left)
            row.append(x)
            room[s] -= x
            left -= x
        matrix.append(row)
    return matrix


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus 8; null text has 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


#: A slice of over HEAVY times its share and HEAVY_ROWS more is dealt anew.
HEAVY, HEAVY_ROWS = 4, 1000


def _counts(rows: DataFrame) -> dict[int, int]:
    return {r["sh_slice"]: r["count"] for r in rows.groupBy("sh_slice").count().collect()}  # at most one row a slice


def shuffle_into_shards(
    docs: DataFrame, shards: int = 24, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, slices: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) for every row.

    Shard sizes differ by at most one row; ``slot`` counts from 0 without gaps within a shard.
    Null text counts as empty, null ids are ordinary ids. Repeated rows are rows of their own, and
    which of two equal rows gets which place is left open. An empty table gives no rows. Only the
    counts of ``slices`` hash slices (by default 1,024, or one for two million rows if that is more) reach the
    driver. Rows of slices that hold many times their share, as equal rows make them, are dealt to more slices by a
    number a row, so that no task holds all of them; where these rows go then depends on how the input is split. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("sh_id"), byte_size(F.col(text)).alias("size"), F.crc32(F.encode(filled, "UTF-8")).alias("text_crc32"))
    rows = scratch.write(rows.withColumn("sh_salt", F.monotonically_increasing_id()))
    slices = max(1024, rows.count() // 2_000_000) if slices is None else slices
    # Independent draws: the first picks a slice, the second orders it, the others do so for a shard.
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "sh_id", "text_crc32", "size", "sh_salt")
    rows = rows.withColumn("sh_slice", F.pmod(F.xxhash64(F.lit(seed), F.lit(0), "sh_id", "text_crc32", "size"), F.lit(slices)).cast("int"))
    found = _counts(rows)
    # rows that are not in a heavy slice are drawn by what they hold alone
    heavy = [i for i, n in found.items() if n > HEAVY * sum(found.values()) / slices + HEAVY_ROWS]
    more = math.ceil(sum(found[i] for i in heavy) * slices / max(1, sum(found.values())))
    rows = rows.withColumn("sh_salt", F.when(F.col("sh_slice").isin(heavy), F.col("sh_salt")).otherwise(F.lit(0)))
    if heavy:
        rows = rows.withColumn("sh_slice", F.when(F.col("sh_slice").isin(heavy), (F.pmod(draw(0), F.lit(more)) + slices).cast("int")).otherwise(F.col("sh_slice")))
        found = _counts(rows)
    counts = [found.get(i, 0) for i in range(slices + more)]
    total = sum(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = []
    for row in communication_matrix(counts, sizes, seed):
        at, edges = 0, []
        for x in row:
            at += x
            edges.append(at)
        cuts.append(edges)
    table = docs.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(cuts)), "array<array<bigint>>")).alias("sh_slice", "sh_cuts"))

    order = Window.partitionBy("sh_slice").orderBy(draw(1), "sh_id", "size", "text_crc32")
    placed = rows.withColumn("sh_rank", F.row_number().over(order) - 1)
    # slices x shards numbers, whatever the rows: a bounded broadcast.
    placed = placed.join(F.broadcast(table), "sh_slice")
    placed = placed.withColumn("shard", F.size(F.filter("sh_cuts", lambda c: c <= F.col("sh_rank"))).cast("int"))
    placed = placed.withColumn("sh_part", F.pmod(draw(2), F.lit(slices)).cast("int"))
    placed = scratch.write(placed.select("sh_id", "size", "text_crc32", "sh_salt", "shard", "sh_part"))
    scratch.drop(rows)

    parts = placed.groupBy("shard", "sh_part").count()
    earlier = Window.partitionBy("shard").orderBy("sh_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "sh_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("sh_before"))
    order = Window.partitionBy("shard", "sh_part").orderBy(draw(3), "sh_id", "size", "text_crc32")
    out = placed.withColumn("sh_rank", F.row_number().over(order) - 1).join(parts, ["shard", "sh_part"])
    return out.select(
        F.col("sh_id").alias(doc_id), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("sh_before") + F.col("sh_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
