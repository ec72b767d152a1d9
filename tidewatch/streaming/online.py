"""Online scoring, one step ahead: the last ``context`` values of each series and feature are state.

An arrival is scored against the mean and band of the values before it, calibrated with a static
table from training; it needs nothing after it. With a watermark, arrivals are held until it has passed
them, so that each key is scored in event-time order however the arrivals are cut into micro-batches;
a timer a key says when its next held arrival is due, or when it has been idle long enough to be forgotten.
Without one there is no order to wait for: arrivals are taken in time order within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.functions.errors import BAND_HALF_WIDTH

OUT = "series_id string, feature string, t long, y double, err double, score double"
STATE = "last array<double>"
#: A held arrival. Those of a key that come together are one value of its state: a value an arrival would each be encoded and passed between Spark and the worker, both ways.
HELD = np.dtype([("at", "i8"), ("t", "i8"), ("y", "f8"), ("mu", "f8"), ("sd", "f8")])
#: Arrivals that leave at once.
PIECE = 1 << 14
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _scored(key: tuple, last: np.ndarray, part: pd.DataFrame, context: int) -> tuple[np.ndarray, pd.DataFrame | None]:
    """The new context, and scores of the arrivals of ``part`` (in order) that have a full one before them."""
    y = part["y"].to_numpy(float)
    line = np.concatenate((last, y))
    scored = len(line) - context
    if scored <= 0:
        return line, None
    seen = np.lib.stride_tricks.sliding_window_view(line[:-1], context)
    low, high = np.quantile(seen, (0.1, 0.9), axis=1)
    part, y = part.iloc[len(y) - scored :], y[len(y) - scored :]
    err = np.abs(y - seen.mean(axis=1)) / np.maximum((high - low) / (2 * BAND_HALF_WIDTH), 1e-3)
    score = (err - part["mu"].to_numpy()) / part["sd"].to_numpy()
    return line[-context:], pd.DataFrame({"series_id": key[0], "feature": key[1], "t": part["t"].to_numpy(), "y": y, "err": err, "score": score})


def _scorer(context: int):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(pdfs)).sort_values("t", kind="stable")
        for at in range(0, len(rows), PIECE):
            last, out = _scored(key, last, rows.iloc[at : at + PIECE], context)
            if out is not None:
                yield out
        state.update((last.tolist(),))

    return run


def _packed(arrivals: pd.DataFrame) -> bytes:
    out = np.empty(len(arrivals), HELD)
    for name in HELD.names:
        out[name] = arrivals[name].to_numpy()
    return out.tobytes()


class InOrder(StatefulProcessor):
    """Holds a key's arrivals until the watermark has passed them; scores them in order of event time, then t, then y.

    State of a key: ``held`` arrivals (packed, ``HELD``), at most those of the watermark's delay; ``past``: its context, the event
    time of the last scored arrival, and when its timer is due (0: none). Times are milliseconds.
    """

    def __init__(self, context: int, idle: int):
        self.context, self.idle = context, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "arrivals binary")
        self.past = handle.getValueState("past", "last array<double>, at long, due long")

    def _past(self) -> tuple[list[float], int | None, int]:
        if not self.past.exists():
            return [], None, 0
        last, at, due = self.past.get()
        return list(last), at, due

    def _wake(self, due: int, before: int) -> int:
        """One timer a key, at ``due``."""
        if due != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows, timerValues):
        last, at, due = self._past()
        first = None
        for pdf in rows:
            self.held.appendValue((_packed(pdf),))
            first = min(int(pdf["at"].min()), first if first is not None else int(pdf["at"].min()))
        if first is not None:
            # a timer that waits for the key to fall idle gives way to one that waits for an arrival
            waits = due if due and not (at is not None and due == at + self.idle) else None
            due = self._wake(min(first, waits) if waits else first, due)
            self.past.update((last, at, due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        last, at, _ = self._past()
        held = np.concatenate([np.empty(0, HELD), *(np.frombuffer(value[0], HELD) for value in self.held.get())])
        ready, waiting = held[held["at"] <= passed], held[held["at"] > passed]
        ready = pd.DataFrame(ready[np.lexsort((ready["y"], ready["t"], ready["at"]))])
        context = np.array(last, float)
        if len(ready):
            times = ready["at"].to_numpy()
            # a key that was idle for too long starts anew, whether its timer has come to free it or not
            gaps = np.diff(times, prepend=at if at is not None else times[0]) > self.idle
            edges = [0, *np.flatnonzero(gaps).tolist(), len(ready)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if gaps[lo]:
                    context = np.zeros(0)
                for x in range(lo, hi, PIECE):
                    context, out = _scored(key, context, ready.iloc[x : min(x + PIECE, hi)], self.context)
                    if out is not None:
                        yield out
            at = int(times[-1])
            self.held.put([(waiting.tobytes(),)]) if len(waiting) else self.held.clear()
        if len(waiting):
            due = int(waiting["at"].min())
        elif at is not None and at + self.idle > passed:
            due = at + self.idle
        else:
            self.held.clear()
            self.past.clear()
            return
        self.handle.registerTimer(due)
        self.past.update((context.tolist(), at, due))


def online_scores(arrivals: DataFrame, calibration: DataFrame, context: int, delay: str | None = None, event_time: str = "ts", idle: str = "30 days") -> DataFrame:
    """``arrivals`` (stream: series_id, feature, t, y, and the timestamp event_time if ``delay`` is given) to scores.

    ``calibration`` is static: (series_id, feature, mu, sd); keys that it lacks have mu 0 and sd 1. With ``delay``
    arrivals are scored once the watermark, that far behind the latest event time, has passed them; those that come
    behind it are dropped by Spark. So the arrivals of the last ``delay`` stay unscored until later ones come. The same
    arrivals give the same scores for any cut into micro-batches in which none is late. A key
    without an arrival for ``idle`` of event time is forgotten, and starts with an empty context if it comes back.

    State is in RocksDB, which this sets for the session. A key's held arrivals are read together when they are
    due: those of ``delay`` and of one micro-batch, so a source needs a limit a trigger (``maxFilesPerTrigger``)
    that fits its busiest key; scores leave in pieces. Without ``delay`` state is not freed.
    """
    rows = arrivals.withWatermark(event_time, delay) if delay else arrivals
    kept = ["series_id", "feature", "t", "y", *([event_time] if delay else [])]
    rows = rows.join(calibration, ["series_id", "feature"], "left").select(*kept, F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("sd", F.lit(1.0)).alias("sd"))
    keyed = rows.withColumn("at", F.unix_millis(F.col(event_time))) if delay else rows
    if not delay:
        return keyed.groupBy("series_id", "feature").applyInPandasWithState(_scorer(context), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return keyed.groupBy("series_id", "feature").transformWithStateInPandas(InOrder(context, wait), OUT, "append", "eventtime")
