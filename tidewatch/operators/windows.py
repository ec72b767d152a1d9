"""Context and horizon windows.

A window over one long series would put all of a feature in one task. Rows are therefore dealt out in
blocks of ``block`` steps; each block also gets copies of the steps before (and after) it that its
windows reach into, and gives results for its own steps only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.operators.running import previous

SERIES = ["series_id", "split", "feature"]
BLOCK = 1 << 15


def with_halo(points: DataFrame, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds w_block; a step appears in its own block and in those that reach into it."""
    if before > block or after > block:
        raise ValueError("windows must not be longer than a block")
    own, place = F.floor(F.col("t") / block), F.col("t") % block
    copies = F.array(own, F.when(place >= block - before, own + 1), F.when(place < after, own - 1))
    return points.withColumn("w_block", F.explode(F.filter(copies, lambda b: b.isNotNull() & (b >= 0))))


def own_rows(windowed: DataFrame, block: int = BLOCK) -> DataFrame:
    return windowed.where(F.floor(F.col("t") / block) == F.col("w_block")).drop("w_block")


def by_time(keys: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES), "w_block").orderBy("t")


def sliding_windows(
    points: DataFrame, context: int, horizon: int = 0, *, keys: list[str] | None = None, block: int = BLOCK, inner: bool = False, least: int | None = None, partial: bool = False, arrays: bool = True
) -> DataFrame:
    """One row an origin t with a full context: ctx (values before t, oldest first) and fut (t and on).

    With a horizon only origins with a full future stay: n - context - horizon + 1 of them, or with
    ``inner`` one fewer (origins below n - horizon). ``least`` lets in contexts of that many values
    and more, at the start of a series; ``partial`` lets in futures that end early. Without ``arrays`` a context is
    not copied into its row: ctx_n, ctx_mean, ctx_first and ctx_last stand for ctx.
    """
    reach = horizon + (1 if inner and horizon else 0)
    w = by_time(keys)
    past = w.rowsBetween(-context, -1)
    if arrays:
        cols = {"ctx": F.collect_list("value").over(past)}
    else:
        ends = {"ctx_first": F.first("value", ignorenulls=True), "ctx_last": F.last("value", ignorenulls=True)}
        cols = {name: c.over(past) for name, c in ({"ctx_n": F.count("value"), "ctx_mean": F.avg("value")} | ends).items()}
    if reach:
        cols["fut"] = F.collect_list("value").over(w.rowsBetween(0, reach - 1))
    out = own_rows(with_halo(points, context, max(reach - 1, 0), block).withColumns(cols), block).where((F.size("ctx") if arrays else F.col("ctx_n")) >= (context if least is None else least))
    if reach:
        out = out.where(F.size("fut") >= (1 if partial else reach)).withColumn("fut", F.slice("fut", 1, horizon))
    return out


def block_origins(points: DataFrame, horizon: int) -> DataFrame:
    """Adds window_id, origin and step: forecasts are made for blocks of ``horizon`` steps, the last one shorter."""
    wid = F.floor(F.col("t") / horizon)
    return points.withColumns({"window_id": wid, "origin": wid * horizon, "step": (F.col("t") % horizon + 1).cast("int")})


def sample_origins(windows: DataFrame, context: int, every: int) -> DataFrame:
    """Every n-th origin, from the first."""
    return windows.where((F.col("t") - context) % every == 0)


def grid_check(stamps: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """n, n_steps (distinct gaps between neighbours, in seconds), rising, regular. Neighbours are found by day (``running.previous``)."""
    near = previous(stamps, keys, ts, "gc_before")
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("gc_before").cast("timestamp"))
    out = near.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("gap").alias("n_steps"), F.coalesce(F.min("gap") >= 0, F.lit(True)).alias("rising"))
    return out.withColumn("regular", F.col("n_steps") <= 1)
