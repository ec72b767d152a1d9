"""Online scores behind a watermark: any cut into micro-batches, late rows, idle keys."""

import datetime
import math
import random

import numpy as np
import pytest

from tidewatch.functions.errors import BAND_HALF_WIDTH
from tidewatch.streaming.online import online_scores

START = datetime.datetime(2024, 1, 1)
SCHEMA = "series_id string, feature string, t long, y double, ts timestamp"
CONTEXT = 4


def run(spark, base, batches, delay="2 hours", idle="30 days"):
    """Scores of arrivals (key, hour, y) that come in the given batches, and the last progress."""
    base.mkdir()
    for rows in batches:
        data = [(k, "f", int(h * 60), float(y), START + datetime.timedelta(hours=h)) for k, h, y in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(base / "in"))
    none = spark.range(0).selectExpr("'' AS series_id", "'' AS feature", "0D AS mu", "1D AS sd")
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
    q = online_scores(arrivals, none, CONTEXT, delay=delay, idle=idle).writeStream.format("parquet")
    q = q.option("checkpointLocation", str(base / "state")).trigger(availableNow=True).start(str(base / "out"))
    q.awaitTermination(300)
    return sorted((r.series_id, r.t, r.score) for r in spark.read.schema("series_id string, t long, score double").parquet(str(base / "out")).collect())


def plain(rows, passed, idle=math.inf):
    """Scores of each key's arrivals up to hour ``passed``, in order."""
    out = []
    for key in {k for k, _, _ in rows}:
        line, before = [], None
        for h, y in sorted((h, y) for k, h, y in rows if k == key and h <= passed):
            if before is not None and h - before > idle:
                line = []
            if len(line) >= CONTEXT:
                seen = line[-CONTEXT:]
                low, high = np.quantile(seen, (0.1, 0.9))
                out.append((key, int(h * 60), abs(y - np.mean(seen)) / max((high - low) / (2 * BAND_HALF_WIDTH), 1e-3)))
            line.append(y)
            before = h
    return sorted(out)


def equal(got, want):
    return [g[:2] for g in got] == [w[:2] for w in want] and all(math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_cut_gives_the_same_scores(spark, tmp_path, seed):
    """Arrivals up to almost two hours out of order, cut at random places, and all at once."""
    rng = random.Random(seed)
    rows = [(k, h + rng.randrange(4) / 4, rng.randrange(20)) for k in "ab" for h in range(24)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 1.9))
    cuts = sorted(rng.sample(range(1, len(rows)), seed + 1))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    end = max(r[1] for r in rows) - 2
    got = run(spark, tmp_path / "cut", batches)
    assert equal(got, plain(rows, end))
    if seed == 1:
        assert equal(run(spark, tmp_path / "whole", [rows]), got)


def test_late_and_very_late_rows(spark, tmp_path):
    """Late but not behind the watermark: scored in place. Behind the watermark that the batch before was scored up to: dropped."""
    first = [("a", h, h % 5) for h in range(0, 10)]
    second = [("a", 8.5, 9), ("a", 10, 1), ("a", 11, 4)]
    third = [("a", 9.5, 3), ("a", 3.5, 7), ("a", 0.5, 7), *[("a", h, h % 3) for h in range(12, 16)]]
    got = run(spark, tmp_path / "x", [first, second, third])
    kept = [r for r in first + second + third if r[1] not in (3.5, 0.5)]
    assert equal(got, plain(kept, 13))


def test_idle_keys_are_forgotten(spark, tmp_path):
    """Keys without an arrival for six hours: no state is left; one that comes back has an empty context."""
    old = [(f"k{i}", h, i + h) for i in range(20) for h in range(6)]
    steady = [("s", h, h % 4) for h in range(0, 40)]
    back = [("k0", h, h % 7) for h in range(30, 38)]
    rows = old + steady + back
    batches = [[r for r in rows if lo <= r[1] < lo + 8] for lo in range(0, 40, 8)]
    got = run(spark, tmp_path / "x", batches, idle="6 hours")
    assert equal(got, plain(rows, 37, idle=6))
    assert equal(run(spark, tmp_path / "y", [rows], idle="6 hours"), got)
    state = spark.read.format("statestore").option("stateVarName", "past").load(str(tmp_path / "x" / "state"))
    assert {r.k for r in state.selectExpr("key.series_id AS k").collect()} == {"s", "k0"}


def test_arrivals_of_a_batch_are_one_value_of_state(spark, tmp_path):
    """However many arrivals of a key wait, its state has one value for each batch that brought some, and gives them back as they were."""
    rows = [("a", 0, 1), *[("a", 100 + i / 64, i % 7) for i in range(64)]]
    got = run(spark, tmp_path / "x", [rows[:40], rows[40:]], delay="90 hours")
    assert got == []
    state = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "x" / "state"))
    assert state.selectExpr("explode(list_value) AS v").count() <= 2 if "list_value" in state.columns else state.count() <= 2
