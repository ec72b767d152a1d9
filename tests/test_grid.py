"""Grids of steps against a plain loop, dealt over many tasks; one fit for filled and scaled points against the three steps."""

import datetime

from tidewatch.operators import prep
from tidewatch.plans import pipelines as pl
from tidewatch.sources import series

START = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_type string, ts timestamp_ntz, value double"


def events(spark):
    hours = {(0, "a"): [0, 3, 511, 512, 1400], (0, "b"): [513], (30, "a"): [1, 1, 1023], (60, "a"): [0], (90, None): [2]}
    rows = [(u, f, START + datetime.timedelta(hours=h, minutes=i), float(h + i) % 9) for (u, f), at in hours.items() for i, h in enumerate(at)]
    return spark.createDataFrame([*rows, (None, "a", START, 1.0), (120, "a", None, 1.0)], SCHEMA), rows


def test_every_step_has_a_row(spark):
    df, rows = events(spark)
    cells, last = {}, {}
    for u, f, ts, v in rows:
        s, t = f"s{u // 25}", int((ts - START).total_seconds() // 3600)
        cells.setdefault((s, f, t), []).append(v)
        last[s] = max(last.get(s, 0), t)
    want = {}
    for s, f in {(s, f) for s, f, _ in cells}:
        for t in range(last[s] + 1):
            v = cells.get((s, f, t)) if f else None
            want[s, f, t] = -1.0 if f and (t + len(f)) % 17 == 0 else v and round(sum(v) / len(v), 6)
    got = series.event_points(df, length="n").collect()
    assert {(r.series_id, r.feature, r.t): r.value for r in got} == want and len(got) == len(want)
    assert all(r.n == last[r.series_id] + 1 for r in got)
    labels = series.event_labels(df, above=5.0).collect()
    top = {(s, t): max(v for (a, _, b), vs in cells.items() for v in vs if (a, b) == (s, t)) for s, _, t in cells}
    assert {(r.series_id, r.t): r.y for r in labels} == {(s, t): int(top.get((s, t), 0.0) > 5) for s in last for t in range(last[s] + 1)}


def test_steps_are_made_in_many_tasks(spark):
    """Spark coalesces small blocks; the steps made from them would all be one task's."""
    df = spark.range(400).selectExpr("id * 25 AS user_id", "'a' AS event_type", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 700 * (id % 2)) AS ts", "1D AS value")
    for made in (series.event_points(df), series.event_labels(df)):
        sizes = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 200 * 701 + 200 and max(sizes) < sum(sizes) / 2


def test_one_fit_equals_three_steps(spark):
    third = 0.1 + 0.2
    rows = [("a", "x", [1.5, None, 4.0, 4.25, None, 9.0]), ("a", "flat", [third] * 3 + [None] * 3), ("a", "empty", [None] * 6), ("b", "x", [None, 1e9 + 0.5, 1e9, None, 1e9 + 2, 1e9])]
    points = spark.createDataFrame([(s, f, "train" if t < 5 else "test", t, v) for s, f, vs in rows for t, v in enumerate(vs)], "series_id string, feature string, split string, t long, value double")
    filled = prep.impute(prep.drop_empty_features(points))
    for scale, want in ((False, filled), (True, prep.zscore(filled))):
        found, expected = ({(r.series_id, r.feature, r.t): r.value for r in df.collect()} for df in (pl.prepared(points, scale), want))
        assert found.keys() == expected.keys() and len(found) == 18
        assert all(abs(found[k] - expected[k]) < 1e-6 for k in found)
    assert prep.filled_fit(points).where("feature = 'flat'").first().sd == 1.0
