"""Connected components of a large sparse graph, by alternating star contraction.

Each round points every node's larger neighbours at its smallest one (large star), then its smaller
neighbours (small star), until nothing moves; the rounds grow with the logarithm of the size. Only
edges move through shuffles. Minima are combined before them, written and read back, so that the join
of a hub's edges with its minimum has plain shuffles on both sides, which Spark can split. Each step is
a written table, so that a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Written edges (a > b) to written edges of each node's smallest neighbour; ``edges`` are dropped."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    low = scratch.write(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
    moved = around.join(low, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        own = low.select("a", F.col("low").alias("b"))
        out = moved.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(own)
    out = scratch.write(out.where("a > b").distinct())
    scratch.drop(edges, low)
    return out


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """(a, b) links between long ids to (node, root): root is the smallest id reachable.

    Only linked nodes are listed. Loops, repeats and nulls are dropped. An empty table gives none.
    """
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = scratch.write(clean)
    seen = None
    for _ in range(max_rounds):
        now = _star(_star(now, True, scratch), False, scratch)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
