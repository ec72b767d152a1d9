"""Joint forecasts: every feature of a series from the last values of all of them.

A vector autoregression with ridge, fitted to the train split of each series. The fit needs only sums of
products of neighbouring steps, which are made in batches of rows and summed in Spark; one small solve a series
gives, for each step ahead and feature, weights on the last ``lags`` values of all features, and a band from
the covariance of the one-step residuals carried forward.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidewatch.functions.arrays import weighted
from tidewatch.functions.errors import BAND_HALF_WIDTH
from tidewatch.operators.forecast import ROUNDING, _array_centres, _sums_of_products, at_places, by_place, unpacked
from tidewatch.operators.windows import BLOCK, by_time, own_rows, with_halo
from tidewatch.sources.shared import cut

STEP = ["series_id", "split"]


def autoregression(m: np.ndarray, size: np.ndarray, lags: int, ridge: float, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """From sums of products of (1, lagged values, values), all about a centre of the given size: [step, feature, 1 + lagged values] weights and [step, feature] deviations.

    ``ridge`` is added to the diagonal of the lagged values' correlations. A value that does not vary has no weight and stands for itself.
    """
    f = (len(m) - 1) // (lags + 1)
    k = lags * f
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    spread = m[1:, 1:] - np.outer(mean, m[0, 1:])
    var = np.diagonal(spread)
    moves = var > n * (size * ROUNDING) ** 2
    scale = np.sqrt(np.where(moves, var, 1.0))
    unit = spread / scale / scale[:, None] * moves * moves[:, None]
    w = np.linalg.solve(unit[:k, :k] + np.diag(np.where(moves[:k], ridge, 1.0)), unit[:k, k:]) if ridge else np.linalg.pinv(unit[:k, :k], rcond=1e-12, hermitian=True) @ unit[:k, k:]
    w = (w / scale[:k, None] * scale[k:]).T  # [feature, lagged value]
    first = np.column_stack([mean[k:] - w @ mean[:k], w])
    rest = spread[k:, k:] - w @ spread[:k, k:] - (w @ spread[:k, k:]).T + w @ spread[:k, :k] @ w.T
    noise = rest / n
    state, shock = np.column_stack([np.zeros(k), np.eye(k)]), np.zeros((k, f))
    weights, var_ahead, total = [], [], np.zeros(f)
    for step in range(horizon):
        ahead = w @ state
        ahead[:, 0] += first[:, 0]
        reply = np.eye(f) if step == 0 else w @ shock
        total = total + np.einsum("ij,jk,ik->i", reply, noise, reply)
        weights.append(ahead)
        var_ahead.append(total)
        state, shock = np.vstack([ahead, state[:-f]]), np.vstack([reply, shock[:-f]])
    return np.stack(weights), np.sqrt(np.maximum(np.stack(var_ahead), 0.0))


def _fits(lags: int, ridge: float, horizon: int):
    kind = StructType([StructField("weights", ArrayType(DoubleType())), StructField("sd", ArrayType(DoubleType()))])

    @F.pandas_udf(kind)
    def solve(sums: pd.Series, centre: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(sums)
        for at, m in unpacked(sums):
            for i, one in zip(at, m):
                size = np.abs(np.asarray(centre.iloc[i], float))
                weights, sd = autoregression(one, size, lags, ridge, horizon)
                out[i] = (weights.ravel().tolist(), sd.ravel().tolist())
        return pd.DataFrame(out, columns=["weights", "sd"])

    return solve


def joint_forecast(points: DataFrame, horizon: int, *, lags: int = 2, ridge: float = 0.01, context: int | None = None, inner: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows as ``forecast`` gives: series_id, split, feature, origin, step, t, point, q10, q50, q90, y.

    Origins are the steps with ``context`` steps (``lags`` by default) before them and a full horizon after them (with
    ``inner`` one step more), the last ``lags`` of them with values of all features. A step that lacks a feature is
    part of no fit. A series needs one more step of training than it has weights a feature (lags times features,
    and one); else, or without a train split, its points are null. Features are those with any value.
    """
    context = lags if context is None else max(context, lags)
    wide = at_places(points, by_place(points)).withColumn("whole", ~F.exists("x", lambda v: v.isNull()))
    w = by_time(STEP)
    reach = horizon + (1 if inner else 0)
    step = F.struct("t", "x", "whole")
    first_of = {"past": F.collect_list(step).over(w.rowsBetween(-lags, -1)), "future": F.collect_list(step).over(w.rowsBetween(0, reach - 1)), "n_before": F.count("*").over(w.rowsBetween(-context, -1))}
    near = own_rows(with_halo(wide, context, reach - 1, block).withColumns(first_of), block)
    follow = (F.size("past") == lags) & (F.get("past", F.lit(0))["t"] == F.col("t") - lags) & F.forall("past", lambda s: s["whole"])
    near = cut(near.where(follow).withColumn("z", F.flatten(F.transform(F.reverse("past"), lambda s: s["x"]))).select("series_id", "split", "t", "features", "x", "whole", "z", "future", "n_before"))

    train = near.where("split = 'train' AND whole")
    values = train.select("series_id", F.lit(-1).cast("long").alias("window_id"), F.col("x").alias("xy"))
    centre = _array_centres(values)  # of the features, which their lagged values share
    all_centres = F.flatten(F.array_repeat("centre", lags + 1))
    away = train.join(centre, "series_id").withColumn("d", F.zip_with(F.concat("z", "x"), all_centres, lambda v, c: v - c)).withColumn("window_id", F.lit(-1).cast("long"))
    packed = _sums_of_products(away).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("m"))
    enough = packed.join(centre, "series_id").where(F.col("m")[0]["s"] > F.size("centre") * lags + 1)
    fit = cut(enough.select("series_id", "centre", _fits(lags, ridge, horizon)(F.transform("m", lambda c: c["s"]), all_centres).alias("fit")))

    origins = near.where((F.col("n_before") == context) & (F.size("future") == reach)).join(fit, "series_id", "left")
    d = F.zip_with("z", F.flatten(F.array_repeat("centre", lags)), lambda v, c: v - c)
    many, wide_by = F.size("features"), F.size("features") * lags + 1
    rows = origins.withColumn("d", F.concat(F.array(F.lit(1.0)), d)).withColumn("i", F.explode(F.sequence(F.lit(0), many * horizon - 1)))
    place, ahead = F.col("i") % many, F.floor(F.col("i") / many).cast("int")
    point = F.get("centre", place) + weighted(F.col("d"), F.slice("fit.weights", F.col("i") * wide_by + 1, wide_by))
    actual = F.get("future", ahead)
    rows = rows.select(
        "series_id", "split", F.get("features", place).alias("feature"), F.col("t").alias("origin"), (ahead + 1).alias("step"), (F.col("t") + ahead).alias("t"),
        point.alias("point"), (F.get("fit.sd", F.col("i")) * BAND_HALF_WIDTH).alias("jf_half"), F.when(actual["t"] == F.col("t") + ahead, F.get(actual["x"], place)).alias("y"),
    )
    return rows.withColumns({"q10": F.col("point") - F.col("jf_half"), "q50": F.col("point"), "q90": F.col("point") + F.col("jf_half")}).drop("jf_half")
