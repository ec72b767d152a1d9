"""Forecasts from context windows.

The contract: for each origin and each of ``horizon`` steps a point and, if asked for, the 10, 50 and 90 %
quantiles. Built-in methods are expressions over the context array. Any other model is a function
from a batch of contexts to points (and quantiles), run over Arrow batches and loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidewatch.functions.arrays import mean, quantile, weighted
from tidewatch.sources.shared import cut, parallel

QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


#: A method's state, one named column each, from the context; and its point at a step (1, 2, ...) from that state.
Method = tuple[Callable[..., dict[str, Column]], Callable[[dict[str, Column], Column], Column]]


def _level(of: Callable[..., Column]) -> Method:
    """A method whose point is the same at every step."""
    return lambda ctx, **options: {"level": of(ctx, **options)}, lambda state, step: state["level"]


def _ses(ctx: Column, alpha: float = 0.3, **_) -> Column:
    """Exponential smoothing from the oldest value on."""
    return F.aggregate(ctx, F.lit(None).cast("double"), lambda level, x: F.coalesce(level * (1 - alpha) + x * alpha, x))


def _cycle(ctx: Column, season: int = 24, **_) -> dict[str, Column]:
    """The last season; of a shorter context, all of it."""
    return {"cycle": F.slice(ctx, F.greatest(F.size(ctx) - season + 1, F.lit(1)), season)}


def _line(ctx: Column, **_) -> dict[str, Column]:
    """The line through the first and the last value."""
    last, slope = F.get(ctx, F.size(ctx) - 1), F.try_divide(F.get(ctx, F.size(ctx) - 1) - F.get(ctx, F.lit(0)), F.size(ctx) - F.lit(1.0))
    return {"last": last, "slope": F.coalesce(slope, F.lit(0.0))}


METHODS: dict[str, Method] = {
    "naive_last": _level(lambda ctx, **_: F.get(ctx, F.size(ctx) - 1)),
    "seasonal_naive": (_cycle, lambda state, step: F.get(state["cycle"], F.pmod(step - 1, F.size(state["cycle"])))),
    "rolling_mean": _level(lambda ctx, **_: mean(ctx)),
    "rolling_median": _level(lambda ctx, **_: quantile(F.sort_array(ctx), 0.5)),
    "drift": (_line, lambda state, step: state["last"] + state["slope"] * step),
    "ses": _level(_ses),
}


def summarised(method: str) -> dict[str, Column] | None:
    """The state of ``method`` from ctx_n, ctx_mean, ctx_first and ctx_last, or None if it needs the values."""
    n, first, last = (F.col(f"ctx_{name}") for name in ("n", "first", "last"))
    slope = F.coalesce(F.try_divide(last - first, n - F.lit(1.0)), F.lit(0.0))
    return {"naive_last": {"level": last}, "rolling_mean": {"level": F.col("ctx_mean")}, "drift": {"last": last, "slope": slope}}.get(method)


def points_of_summaries(windows: DataFrame, method: str, horizon: int) -> DataFrame:
    """``forecast`` without quantiles or options, for windows made without arrays and a method that ``summarised`` knows."""
    state = summarised(method)
    if state is None:
        raise ValueError(f"{method!r} needs the values of a context")
    own = {"f_" + name: c for name, c in state.items()}
    rows = windows.withColumnRenamed("t", "origin").withColumns(own).drop("ctx_n", "ctx_mean", "ctx_first", "ctx_last")
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("t", F.col("origin") + F.col("step") - 1)
    rows = rows.withColumn("point", METHODS[method][1]({name: F.col("f_" + name) for name in state}, F.col("step")))
    if "fut" in windows.columns:
        rows = rows.withColumn("y", F.get("fut", F.col("step") - 1))
    return rows.drop("fut", *own)


def _ses_gaps(ctx: Column, alpha: float = 0.3, **_) -> Column:
    """Each value but the oldest against the level before it."""
    start = F.struct(F.get(ctx, F.lit(0)).alias("level"), F.array().cast("array<double>").alias("gaps"))
    step = lambda s, x: F.struct((s.level * (1 - alpha) + x * alpha).alias("level"), F.array_append(s.gaps, x - s.level).alias("gaps"))
    return F.aggregate(F.slice(ctx, 2, F.greatest(F.size(ctx) - 1, F.lit(0))), start, step, lambda s: s.gaps)


def _line_gaps(ctx: Column, **_) -> Column:
    """Each value but the oldest against the line through the oldest and the one before it."""
    last = lambda i: F.get(ctx, i)
    slope = lambda i: F.when(i > 0, (last(i) - last(F.lit(0))) / i).otherwise(F.lit(0.0))
    return F.transform(F.slice(ctx, 2, F.greatest(F.size(ctx) - 1, F.lit(0))), lambda x, i: x - last(i) - slope(i))


def _lagged_gaps(ctx: Column, season: int = 24, **_) -> Column:
    return F.transform(F.slice(ctx, season + 1, F.greatest(F.size(ctx) - season, F.lit(0))), lambda x, i: x - F.get(ctx, i))


#: Of methods that follow a level or trend: what each value of the context differs by from the method's own forecast of it, one
#: step ahead, and how many times wider errors are at a step (1, 2, ...), from the step and the context's size.
RESIDUALS: dict[str, tuple[Callable[..., Column], Callable[..., Column]]] = {
    "naive_last": (lambda ctx, **_: _lagged_gaps(ctx, season=1), lambda step, n, **_: F.sqrt(step.cast("double"))),
    "seasonal_naive": (_lagged_gaps, lambda step, n, season=24, **_: F.sqrt(F.floor((step - 1) / season) + 1.0)),
    "drift": (_line_gaps, lambda step, n, **_: F.sqrt(step * (1 + step / F.greatest(n - 1, F.lit(1))))),
    "ses": (_ses_gaps, lambda step, n, alpha=0.3, **_: F.sqrt(1 + (step - 1) * (alpha * alpha))),
}


def forecast(
    windows: DataFrame, method: str, context: int, horizon: int, *, quantiles: bool = True, non_negative: bool = False, flip: bool = False, normalize: bool = False, **options
) -> DataFrame:
    """``windows`` (with ctx) to one row an origin and step: the other columns, origin, step, t, point, q10, q50, q90, and the actual y where ``windows`` has fut.

    Quantiles are those of the context for methods of a mean or median. For those that follow a level or trend they are the
    point and the quantiles of the method's one-step errors within the context, widened with the step; a
    context too short to have any gives its own quantiles, moved to the point.
    ``normalize`` forecasts the z-scored context; ``non_negative`` cuts at 0 where the context has no
    negative value; ``flip`` averages the forecast with that of the negated context, negated. Contexts
    may be short at the start of a series; an empty one gives null.

    What follows from the context alone is computed once a window; the steps are exploded last, without it.
    """
    rows, own, point, band = _stated(windows, method, context, quantiles, non_negative, flip, normalize, options)
    rows = rows.drop("ctx").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("t", F.col("origin") + F.col("step") - 1)
    rows = rows.withColumn("point", point(F.col, F.col("step")))
    if "fut" in windows.columns:
        rows = rows.withColumn("y", F.get("fut", F.col("step") - 1))
    if quantiles:
        rows = rows.withColumns(band(F.col, F.col("step"), F.col("point")))
    return rows.drop("fut", *own)


def mean_errors(windows: DataFrame, method: str, context: int, horizon: int, error: Callable[[Column, Column, Column, Column], Column], *, non_negative: bool = False, flip: bool = False, normalize: bool = False, **options) -> DataFrame:
    """The mean over the horizon of ``error(y, point, q10, q90)`` as ``err``, one row a window, from windows with ctx and fut. Steps never become rows, so none are shuffled; nulls are skipped."""
    rows, own, point, band = _stated(windows, method, context, True, non_negative, flip, normalize, options)
    made = [*own, *QUANTILES]

    def at(state: Column, pair: Column) -> Column:
        p = point(lambda name: state[name], pair["step"])
        q = band(lambda name: state[name], pair["step"], p)
        return error(pair["y"], p, q["q10"], q["q90"])

    # the state is an argument, so that it is found once a window and not once a step
    steps = F.transform(F.slice("fut", 1, horizon), lambda y, i: F.struct((i + 1).alias("step"), y.alias("y")))
    errors = F.zip_with(F.array_repeat(F.struct(*made), F.size("fut")), steps, at)
    return rows.withColumn("err", mean(F.filter(errors, lambda e: e.isNotNull()))).drop("ctx", "fut", *made)


def _stated(windows: DataFrame, method: str, context: int, quantiles: bool, non_negative: bool, flip: bool, normalize: bool, options: dict):
    """``windows`` with what follows from the context alone, the names of the columns made for it, and the point and the band of a step from these columns (by name) and the step."""
    if method not in METHODS:
        raise ValueError(f"unknown forecast method {method!r}; known: {', '.join(METHODS)}")
    prepare, at = METHODS[method]
    ctx, rows = F.col("ctx"), windows.withColumnRenamed("t", "origin")
    own = []  # columns made here, dropped at the end

    def add(columns: dict[str, Column]) -> None:
        nonlocal rows
        rows = rows.withColumns(columns)
        own.extend(columns)

    if normalize:
        add({"f_mu": mean(ctx)})
        add({"f_sd": F.greatest(F.sqrt(mean(F.transform(ctx, lambda x: (x - F.col("f_mu")) * (x - F.col("f_mu"))))), F.lit(1e-8))})
    used = F.transform(ctx, lambda x: (x - F.col("f_mu")) / F.col("f_sd")) if normalize else ctx
    sides = {"f_": used} | ({"g_": F.transform(used, lambda x: -x)} if flip else {})
    names = []
    for side, values in sides.items():
        state = prepare(values, context=context, **options)
        add({side + name: c for name, c in state.items()})
        names = list(state)
    if non_negative:
        add({"f_cut": F.array_min(ctx) >= 0})
    gaps_of, wider = RESIDUALS.get(method, (None, None))
    if quantiles:
        if gaps_of is not None:
            rows = rows.withColumn("f_gaps", F.sort_array(gaps_of(ctx, **options)))
            rows = rows.withColumns({f"f_gap{name}": quantile(F.col("f_gaps"), p) for name, p in QUANTILES.items()}).withColumn("f_n", F.size(ctx))
            own.extend([*(f"f_gap{name}" for name in QUANTILES), "f_n"])
        lone = F.lit(True) if gaps_of is None else F.size("f_gaps") <= 0
        rows = rows.withColumn("f_sorted", F.when(lone, F.sort_array(ctx)))
        rows = rows.withColumns({name: quantile(F.col("f_sorted"), p) for name, p in QUANTILES.items()}).drop("f_sorted", "f_gaps")

    def positive(get: Callable[[str], Column], c: Column) -> Column:
        return F.when(get("f_cut"), F.greatest(c, F.lit(0.0))).otherwise(c) if non_negative else c

    def point(get: Callable[[str], Column], step: Column) -> Column:
        c = at({name: get("f_" + name) for name in names}, step)
        if flip:
            c = (c - at({name: get("g_" + name) for name in names}, step)) / 2
        return positive(get, c * get("f_sd") + get("f_mu") if normalize else c)

    def band(get: Callable[[str], Column], step: Column, point: Column) -> dict[str, Column]:
        found = {q: get(q) for q in QUANTILES}
        if gaps_of is not None:
            width = wider(step, get("f_n"), **options)
            found = {q: F.coalesce(point + get(f"f_gap{q}") * width, get(q) + point - get("q50")) for q in QUANTILES}
        return {q: positive(get, c) for q, c in found.items()}

    return rows, own, point, band


def apply_model(windows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], horizon: int) -> DataFrame:
    """Forecasts of a user's model: ``load()`` runs once a worker batch stream and gives a function from (batch, context) to (batch, horizon) or (batch, horizon, 3).

    Contexts shorter than the longest of their batch begin with NaN. Output as ``forecast``; quantiles are null where
    the model gives points only. For a model of all features at once see ``operators.tensors``.
    """
    keys = [c for c in windows.columns if c not in ("ctx", "fut", "t")]
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "origin long", "step int", "t long", "point double", "q10 double", "q50 double", "q90 double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            if not len(pdf):
                continue
            longest = max(pdf["ctx"].map(len))
            out = np.asarray(model(np.stack([np.pad(np.asarray(c, float), (longest - len(c), 0), constant_values=np.nan) for c in pdf["ctx"]])), float)
            n = len(pdf)
            res = pdf[keys].loc[pdf.index.repeat(horizon)].reset_index(drop=True)
            res["origin"] = np.repeat(pdf["t"].to_numpy(), horizon)
            res["step"] = np.tile(np.arange(1, horizon + 1, dtype=np.int32), n)
            res["t"] = res["origin"] + res["step"] - 1
            if out.ndim == 3:
                res["point"] = out[:, :, 1].ravel()
                for i, q in enumerate(QUANTILES):
                    res[q] = out[:, :, i].ravel()
            else:
                res["point"] = out.ravel()
                for q in QUANTILES:
                    res[q] = None
            yield res

    return windows.select(*keys, "t", "ctx").mapInPandas(run, schema)


#: A spread of this share of a value's size is rounding.
ROUNDING = 1e-15


def covariate_forecast(points: DataFrame, target: str, covariate: str, horizon: int) -> DataFrame:
    """The target from one known covariate: for each block of ``horizon`` test steps, least squares on everything before it.

    Sums for the fit are running totals by block, so a block costs no pass over its past. They are of
    distances from a centre near the first values of the fit (``_centres``), so that they keep their digits far from 0.
    """
    pair = points.where(F.col("feature").isin(target, covariate)).groupBy("series_id", "split", "t")
    pair = pair.agg(F.max(F.when(F.col("feature") == target, F.col("value"))).alias("y"), F.max(F.when(F.col("feature") == covariate, F.col("value"))).alias("x"))
    pair = cut(_blocks(pair, horizon))
    both = pair.where("x is not null and y is not null")
    centre = _centres(both, {"cx": F.avg("x"), "cy": F.avg("y")})
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    sums = both.join(centre, "series_id").groupBy("series_id", "window_id")
    sums = sums.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    # blocks without a row to fit on still need the sums before them
    every = pair.select("series_id", "window_id").distinct().join(sums, ["series_id", "window_id"], "left")
    before = Window.partitionBy("series_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    past = every.select("series_id", "window_id", *(F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy"))).where("n > 0").join(centre, "series_id")
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    spread = F.col("sxx") - mx * F.col("sx")
    flat = spread <= F.col("n") * (F.abs("cx") * ROUNDING) * (F.abs("cx") * ROUNDING)
    slope = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("sxy") - mx * F.col("sy"), spread))
    fit = past.select("series_id", "window_id", "cx", "cy", mx.alias("mx"), my.alias("my"), F.coalesce(slope, F.lit(0.0)).alias("slope"))
    out = pair.where("split = 'test'").join(fit, ["series_id", "window_id"], "left")
    point = F.col("cy") + (F.col("my") + F.col("slope") * (F.col("x") - F.col("cx") - F.col("mx")))
    return out.select("series_id", F.lit(target).alias("feature"), "window_id", "t", "y", point.alias("point"))


def _blocks(rows: DataFrame, horizon: int) -> DataFrame:
    """Adds window_id: -1 for the train split, then blocks of ``horizon`` test steps."""
    return rows.withColumn("window_id", F.when(F.col("split") == "train", F.lit(-1)).otherwise(F.floor(F.col("t") / horizon)).cast("long"))


def _centres(fitting: DataFrame, means: dict[str, Column]) -> DataFrame:
    """A series' ``means`` over the first block that has rows to fit on.

    Every fit holds that block. With n rows in a fit and m in the block, sums of squares about the centre are at most 1 + n / m
    times those about the fit's own mean, however far the series lies from 0 or drifts: taking the mean away
    afterwards costs at most the digits of that factor.
    """
    by_block = fitting.groupBy("series_id", "window_id").agg(F.struct(*(m.alias(name) for name, m in means.items())).alias("c"))
    return by_block.groupBy("series_id").agg(F.min_by("c", "window_id").alias("c")).select("series_id", "c.*")


#: Products that a batch holds at once.
PRODUCTS = 1 << 22


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (series, block, d: distances from the centre) to at least one row a series, block and batch: the upper triangle of the sums of products of (1, d)."""
    for batch in batches:
        series, blocks = batch.column("series_id"), batch.column("window_id")
        sizes = batch.column("d").value_lengths().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = batch.column("d").flatten().to_numpy(zero_copy_only=False)
        group = pd.DataFrame({"s": series.dictionary_encode().indices.to_pandas(), "w": blocks.to_numpy()}).groupby(["s", "w"], sort=False, dropna=False).ngroup().to_numpy()
        for size in np.unique(sizes):
            i, j = np.triu_indices(size + 1)
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(group[at], kind="stable")]
            for part in np.split(at, range(0, len(at), max(PRODUCTS // len(i), 1))[1:]):
                x = np.column_stack([np.ones(len(part)), flat[starts[part][:, None] + np.arange(size)]])
                first = np.flatnonzero(np.diff(group[part], prepend=-1))
                sums = np.add.reduceat(x[:, i] * x[:, j], first, axis=0)
                lists = pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * len(i), sums.ravel())
                yield pa.RecordBatch.from_arrays([series.take(pa.array(part[first])), blocks.take(pa.array(part[first])), lists], ["series_id", "window_id", "sums"])


def _parts_of_sums(away: DataFrame) -> DataFrame:
    """(series_id, window_id, i, s): the triangles of ``_products``, place by place, some in several parts."""
    kind = away.schema["series_id"].dataType.simpleString()
    parts = away.select("series_id", "window_id", "d").mapInArrow(_products, f"series_id {kind}, window_id long, sums array<double>")
    return parts.select("series_id", "window_id", F.posexplode("sums").alias("i", "s"))


def _sums_of_products(away: DataFrame) -> DataFrame:
    return _parts_of_sums(away).groupBy("series_id", "window_id", "i").agg(F.sum("s").alias("s"))


def unpacked(sums: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and full matrices of the upper triangles of each size."""
    sizes = sums.map(len)
    for length in sizes.unique():
        at = np.flatnonzero(sizes == length)
        k = int(((8 * length + 1) ** 0.5 - 1) // 2)
        m = np.zeros((len(at), k, k))
        m[(slice(None), *np.triu_indices(k))] = np.stack(sums.iloc[at].to_list())
        yield at, np.triu(m, 1).transpose(0, 2, 1) + m


def least_squares(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Means of (x, y), then weights, for each of a stack of sums of products of (1, x, y); ``size`` are the centres' sizes, below whose rounding a spread counts as none.

    The sums are brought to the mean and to unit spread, so that neither offsets nor scales cost digits; a
    covariate that follows from the others takes no more than its share.
    """
    n = m[:, :1, 0]
    mean = m[:, 0, 1:] / n
    spread = m[:, 1:, 1:] - mean[:, :, None] * m[:, :1, 1:]
    var = np.diagonal(spread, axis1=1, axis2=2)
    moves = var > n * (size * ROUNDING) ** 2
    scale = np.where(moves, np.sqrt(np.where(moves, var, 1.0)), np.inf)
    unit = spread / scale[:, :, None] / scale[:, None, :]
    weights = np.linalg.pinv(unit[:, :-1, :-1], rcond=1e-12, hermitian=True) @ unit[:, :-1, -1:]
    weights = np.where(np.isfinite(scale[:, :-1]), weights[:, :, 0] / np.where(np.isfinite(scale[:, :-1]), scale[:, :-1], 1.0), 0.0) * np.where(moves[:, -1:], scale[:, -1:], 0.0)
    return np.hstack([mean, weights])


@F.pandas_udf(ArrayType(DoubleType()))
def _solved(sums: pd.Series, centre: pd.Series, target: pd.Series) -> pd.Series:
    """``least_squares`` of the place ``target`` from all others, from the upper triangles; those of one size and target together."""
    out: list = [None] * len(sums)
    places = target.to_numpy()
    for at, m in unpacked(sums):
        size = np.abs(np.stack(centre.iloc[at].to_list()).astype(float))
        for t in np.unique(places[at]):
            own = np.flatnonzero(places[at] == t)
            order = np.append(np.delete(np.arange(size.shape[1]), t), t)
            all_places = np.append(0, order + 1)
            found = least_squares(m[own][:, all_places][:, :, all_places], size[own][:, order])
            for i, row in zip(at[own], found):
                out[i] = row.tolist()
    return pd.Series(out)


def by_place(points: DataFrame) -> DataFrame:
    """series_id, features: the names of a series' features that have any value, in order; their places in arrays."""
    return points.where("value is not null").select("series_id", "feature").distinct().groupBy("series_id").agg(F.sort_array(F.collect_list("feature")).alias("features"))


def at_places(points: DataFrame, places: DataFrame) -> DataFrame:
    """series_id, split, t, features, x: the values of a step by place, null where there is none."""
    pair = F.when(F.col("value").isNotNull(), F.struct("feature", "value"))
    wide = points.groupBy("series_id", "split", "t").agg(F.map_from_entries(F.collect_list(pair)).alias("found")).join(places, "series_id")
    return wide.withColumn("x", F.transform("features", lambda f: F.col("found")[f])).drop("found")


#: Steps of a series that are dealt together.
DEALT = 1 << 12


def covariates_forecast(points: DataFrame, target: str, horizon: int) -> DataFrame:
    """As ``covariate_forecast`` with all other features of the series."""
    return covariates_forecasts(points, [target], horizon)


def covariates_forecasts(points: DataFrame, targets: list[str], horizon: int) -> DataFrame:
    """``covariates_forecast`` for each of several targets.

    A series' features have fixed places, by name. A step that lacks a value of any of them has a null
    point and is no part of a fit. So all targets have the same steps to fit on and the same sums of products, in
    another order: sums, of distances from the series' centre, are made once, by block in
    batches of rows, summed in Spark, and run up over the blocks; only the running sums reach the solver.
    """
    wide = at_places(points, by_place(points))
    # steps of a block are made neighbours, so that a batch of rows sums many steps of each
    dealt = _blocks(wide, horizon).repartition(parallel(points.sparkSession), "series_id", "split", F.floor(F.col("t") / DEALT))
    wide = cut(dealt.sortWithinPartitions("series_id", "window_id"))
    fitting = wide.where(~F.exists("x", lambda v: v.isNull())).select("series_id", "window_id", F.col("x").alias("xy"))
    centre = cut(_array_centres(fitting))
    parts = _parts_of_sums(fitting.join(centre, "series_id").withColumn("d", F.zip_with("xy", "centre", lambda v, c: v - c)))
    # blocks without a row to fit on still need the sums before them
    many = F.size("centre") + 1
    blocks = wide.where("split = 'test'").select("series_id", "window_id").distinct().join(centre, "series_id")
    cells = blocks.select("series_id", "window_id", F.explode(F.sequence(F.lit(0), F.floor(many * (many + 1) / 2).cast("int") - 1)).alias("i"), F.lit(0.0).alias("s"))
    every = parts.unionByName(cells).groupBy("series_id", "window_id", "i").agg(F.sum("s").alias("s"))
    before = Window.partitionBy("series_id", "i").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    past = every.withColumn("s", F.sum("s").over(before)).where("s is not null")
    packed = past.groupBy("series_id", "window_id").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("m")).where(F.col("m")[0]["s"] > 0)
    found = packed.select("series_id", "window_id", F.transform("m", lambda c: c["s"]).alias("m")).join(centre, "series_id")

    target = F.explode(F.array(*(F.lit(t) for t in targets))).alias("feature")
    place = (F.array_position("features", F.col("feature")) - 1).cast("int")  # -1 where the series has no value of the target
    names = wide.select("series_id", "features").distinct().select("series_id", "features", target).select("series_id", "feature", place.alias("place"))
    fit = found.join(names.where("place >= 0"), "series_id").select("series_id", "window_id", "feature", "centre", _solved("m", "centre", "place").alias("fit"))
    rows = wide.where("split = 'test'").select("*", target).withColumn("place", place)
    rows = rows.withColumn("y", F.get("x", F.col("place"))).withColumn("x", _without("x", F.col("place"))).where(F.size("x") > 0)
    out = rows.drop("features").join(fit, ["series_id", "window_id", "feature"], "left")
    k = F.size("x")
    far = F.zip_with(F.zip_with("x", _without("centre", F.col("place")), lambda v, c: v - c), F.slice("fit", 1, k), lambda v, mean: v - mean)
    point = F.get("centre", F.col("place")) + (F.get("fit", k) + weighted(far, F.slice("fit", k + 2, k)))
    return out.select("series_id", "feature", "window_id", "t", "y", F.when(~F.exists("x", lambda v: v.isNull()), point).alias("point"))


def _without(array: str, place: Column) -> Column:
    return F.filter(array, lambda _, i: i != place)


def _array_centres(fitting: DataFrame) -> DataFrame:
    """``_centres`` of the places of the array ``xy``."""
    first = fitting.groupBy("series_id").agg(F.min("window_id").alias("window_id"))
    cells = fitting.join(first, ["series_id", "window_id"]).select("series_id", F.posexplode("xy").alias("i", "v")).groupBy("series_id", "i").agg(F.avg("v").alias("c"))
    return cells.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
