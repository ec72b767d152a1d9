"""Models that see all features of a series at once: window tensors in batches.

Steps leave Spark once, as rows of all features, in blocks of a series with the steps around them that its
windows reach into; windows are cut inside the task, as views. So a value moves once (and once more at a
block's edge), not once a window. Windows of series with the same features share batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.forecast import QUANTILES, at_places, by_place
from tidewatch.operators.windows import with_halo

#: Steps of a block.
STEPS = 4096


@dataclass
class Windows:
    """A batch of B windows of series with the same features.

    ``values`` [B, features, context] ends with the step before the origin; ``seen`` says which are there (others are
    NaN): a short context is missing at its beginning. ``future`` and ``future_seen`` [B, known, horizon] are the known covariates from the origin on.
    """

    features: tuple[str, ...]
    known: tuple[str, ...]
    values: np.ndarray
    seen: np.ndarray
    future: np.ndarray
    future_seen: np.ndarray


#: From a batch to points [B, targets, horizon], or points with quantiles [B, targets, horizon, 3]; targets are the features that are not known ahead.
Model = Callable[[Windows], np.ndarray]


def _cut(t: np.ndarray, x: np.ndarray, own: np.ndarray, context: int, horizon: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Origins of a block, and [origin, feature, step] of their contexts and their futures."""
    first = t[0] - context
    line = np.full((context + int(t[-1] - t[0]) + 1, x.shape[1]), np.nan)
    line[t - first] = x
    origins = t[own & (t - least >= t[0]) & (t + horizon - 1 <= t[-1])]
    past = np.lib.stride_tricks.sliding_window_view(line, context, axis=0)[origins - context - first]
    ahead = np.lib.stride_tricks.sliding_window_view(line, horizon, axis=0)[origins - first]
    return origins, past, ahead


def apply_joint_model(
    points: DataFrame, load: Callable[[], Model], context: int, horizon: int, *, known: tuple[str, ...] = (), least: int | None = None, batch: int = 512, block: int = STEPS
) -> DataFrame:
    """Forecasts of a model that takes all features: series_id, split, feature, origin, step, t, point, q10, q50, q90, y.

    ``load()`` runs once a task and gives the model. Origins have ``least`` steps (``context`` by default) or more
    before them and ``horizon`` from them on, train and test apart. Steps and values that are missing are NaN and
    unseen, and so is what lies before a series' start. ``known`` features are given ahead and not forecast; a
    series that lacks one has it unseen. Quantiles are null where the model gives points only.
    """
    least = context if least is None else least
    wide = at_places(points, by_place(points))
    rows = with_halo(wide, context, horizon - 1, block).select("series_id", "split", "w_block", "t", "features", "x")
    dealt = rows.repartition("series_id", "split", "w_block").sortWithinPartitions("series_id", "split", "w_block", "t")
    kind = points.schema["series_id"].dataType.simpleString()
    schema = f"series_id {kind}, split string, feature string, origin long, step int, t long, point double, q10 double, q50 double, q90 double, y double"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, waiting = load(), {}

        def predict(features: tuple[str, ...]) -> pd.DataFrame:
            parts = waiting.pop(features)
            names, past, ahead = [n for p in parts for n in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            targets = [i for i, f in enumerate(features) if f not in known]
            future = np.full((len(past), len(known), horizon), np.nan)
            for k, f in enumerate(known):
                if f in features:
                    future[:, k] = ahead[:, features.index(f)]
            out = np.asarray(model(Windows(features, tuple(known), past, ~np.isnan(past), future, ~np.isnan(future))), float)
            if out.shape[:3] != (len(past), len(targets), horizon):
                raise ValueError(f"the model gave {out.shape} for {(len(past), len(targets), horizon)}")
            many = len(targets) * horizon
            res = pd.DataFrame([n for n in names for _ in range(many)], columns=["series_id", "split", "origin"])
            res["feature"] = np.tile(np.repeat([features[i] for i in targets], horizon), len(past))
            res["step"] = np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(past) * len(targets))
            res["t"] = res["origin"] + res["step"] - 1
            band = out.reshape(-1, 3) if out.ndim == 4 else None
            res["point"] = out.ravel() if band is None else band[:, 1]
            for i, q in enumerate(QUANTILES):
                res[q] = None if band is None else band[:, i]
            y = ahead[:, targets].ravel()
            res["y"] = np.where(np.isnan(y), None, y)
            return res[["series_id", "split", "feature", "origin", "step", "t", "point", *QUANTILES, "y"]]

        def take(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            features = tuple(group["features"].iloc[0])
            x = np.array([[np.nan if v is None else v for v in row] for row in group["x"]], float).reshape(len(group), len(features))
            t = group["t"].to_numpy()
            origins, past, ahead = _cut(t, x, t // block == group["w_block"].iloc[0], context, horizon, least)
            name = (group["series_id"].iloc[0], group["split"].iloc[0])
            for lo in range(0, len(origins), batch):
                held = waiting.setdefault(features, [])
                held.append(([(*name, int(o)) for o in origins[lo : lo + batch]], past[lo : lo + batch], ahead[lo : lo + batch]))
                if sum(len(p[0]) for p in held) >= batch:
                    yield predict(features)

        rest = None
        for pdf in pdfs:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            ids = pdf[["series_id", "split", "w_block"]]
            edges = [0, *(np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy()[1:]) + 1).tolist()]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield from take(pdf.iloc[lo:hi])
            rest = pdf.iloc[edges[-1] :]  # the last group may go on
        if rest is not None and len(rest):
            yield from take(rest)
        for features in list(waiting):
            yield predict(features)

    return dealt.mapInPandas(run, schema)
