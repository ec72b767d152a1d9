"""Models of all features against a plain loop over windows."""

import numpy as np
import pytest

from tidewatch.operators.tensors import apply_joint_model

SCHEMA = "series_id string, split string, t long, feature string, value double"


def mixing():
    def load():
        """Mixes features: each target is what its last seen value, the mean of all that is seen and the known values ahead add up to."""

        def model(w):
            targets = [i for i, f in enumerate(w.features) if f not in w.known]
            out = np.zeros((len(w.values), len(targets), w.future.shape[2], 3))
            for b in range(len(w.values)):
                mean = w.values[b][w.seen[b]].mean() if w.seen[b].any() else 0.0
                ahead = np.where(w.future_seen[b], w.future[b], -1.0).sum(axis=0)
                for k, i in enumerate(targets):
                    seen = w.values[b, i][w.seen[b, i]]
                    out[b, k, :, 1] = (seen[-1] if len(seen) else 0.0) + mean + ahead + len(seen)
            out[..., 0], out[..., 2] = out[..., 1] - 1, out[..., 1] + 1
            return out

        return model

    return load


def plain(rows, context, horizon, known, least):
    by = {}
    for s, split, t, f, v in rows:
        by.setdefault((s, split), {}).setdefault(t, {})[f] = v
    features = {s: sorted({f for x, _, _, f, v in rows if x == s and v is not None}) for s, *_ in rows}
    out = {}
    for (s, split), steps in by.items():
        for o in steps:
            if o - least < min(steps) or o + horizon - 1 > max(steps):
                continue
            value = lambda t, f: steps.get(t, {}).get(f)  # noqa: B023, E731
            held = {f: [v for t in range(o - context, o) if (v := value(t, f)) is not None] for f in features[s]}
            every = [v for f in features[s] for v in held[f]]
            for f in features[s]:
                if f in known:
                    continue
                for k in range(horizon):
                    ahead = sum(-1.0 if f2 not in features[s] or value(o + k, f2) is None else value(o + k, f2) for f2 in known)
                    point = (held[f][-1] if held[f] else 0.0) + (np.mean(every) if every else 0.0) + ahead + len(held[f])
                    out[s, split, f, o, k + 1] = (point, value(o + k, f))
    return out


@pytest.mark.parametrize(("block", "batch"), [(4096, 512), (16, 5)])
def test_model_equals_a_loop(spark, block, batch):
    """Short contexts, missing steps and values, a train and a test split, series with other features, one shorter than a window."""
    rng = np.random.default_rng(6)
    rows = []
    for s, names, n in (("p", "abc", 90), ("q", "abc", 41), ("r", "ac", 60), ("tiny", "abc", 3)):
        for i in range(n):
            split, t = ("train", i) if i < n // 3 else ("test", i - n // 3)
            if rng.random() < 0.05 and i not in (0, n // 3, n - 1, n // 3 - 1):
                continue
            rows += [(s, split, t, f, None if rng.random() < 0.1 else float(np.round(rng.normal(), 3))) for f in names]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = apply_joint_model(df, mixing(), 8, 3, known=("b",), least=2, batch=batch, block=block).collect()
    want = plain(rows, 8, 3, ("b",), 2)
    assert {(r.series_id, r.split, r.feature, r.origin, r.step) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        point, y = want[r.series_id, r.split, r.feature, r.origin, r.step]
        assert abs(r.point - point) < 1e-9 and r.y == y and r.t == r.origin + r.step - 1
        assert abs(r.q10 - point + 1) < 1e-9 and abs(r.q90 - point - 1) < 1e-9


def test_points_without_quantiles_and_empty_tables(spark):
    df = spark.createDataFrame([("s", "test", t, "f", float(t)) for t in range(10)], SCHEMA)
    got = apply_joint_model(df, lambda: lambda w: w.values[:, :, -1:].repeat(2, axis=2), 4, 2).collect()
    assert sorted((r.origin, r.step, r.point, r.q10, r.y) for r in got) == [(o, k, o - 1.0, None, o + k - 1.0) for o in range(4, 9) for k in (1, 2)]
    assert apply_joint_model(spark.createDataFrame([], SCHEMA), lambda: lambda w: w.values, 4, 2).collect() == []
    with pytest.raises(Exception, match="the model gave"):
        apply_joint_model(df, lambda: lambda w: w.values, 4, 2).collect()
