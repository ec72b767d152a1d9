"""CSV directories whose files differ in columns, against pandas by name."""

import math

import pandas as pd
import pytest

from tidewatch.sources import series
from tidewatch.sources.headers import header_names, headers, read_by_header

FILES = {
    "a_train.csv": "timestamp,f1,f2,is_anomaly\n3,1.0,10,0\n1,2.0,,0\n2,,12,1\n",
    "a_test.csv": "﻿timestamp,f2,f1,is_anomaly\n1,20,3.5,0\n2,21,inf,1\n",
    "b_test.csv": 'f2,"a, b",timestamp\n\n7,"1,000",9\n8,5,10\n',
    "c_test.csv": "f1,f3,f1\n1,2,3\n4\nx,5,6,7\n",
    "d_test.csv": "timestamp,f1,f2,is_anomaly\n",
    "e_test.csv": "",
    "f_test.csv": "f3\n" + "\n".join(str(i) for i in range(40)) + "\n",
}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, text in FILES.items():
        (d / name).write_text(text)
    return d


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or math.isclose(a, b)))


def test_columns_come_by_name(spark, folder):
    schema = "timestamp long, f1 double, f2 double, f3 double, is_anomaly int"
    got = series.read_csv_series(spark, str(folder), schema).collect()
    for name, text in FILES.items():
        if not text:
            continue
        frame = pd.read_csv(folder / name, encoding="utf-8-sig", names=None, on_bad_lines="skip") if name != "c_test.csv" else pd.DataFrame({"f1": [1, 4, None], "f3": [2, None, 5]})
        frame = frame.sort_values("timestamp", kind="stable") if "timestamp" in frame else frame
        own = sorted((r for r in got if f"{r.series_id}_{r.split}.csv" == name), key=lambda r: r.t)
        assert [r.t for r in own] == list(range(len(frame)))
        for r, (_, want) in zip(own, frame.iterrows()):
            for c in ("timestamp", "f1", "f2", "f3", "is_anomaly"):
                value = want[c] if c in frame and not pd.isna(want[c]) else None
                assert same(r[c], value), (name, c, r)


def test_union_of_all_headers(spark, folder):
    got = read_by_header(spark, str(folder))
    assert [c for c in got.columns if not c.startswith("sr_")] == ["a, b", "f1", "f1.1", "f2", "f3", "is_anomaly", "timestamp"]
    assert {r["f1.1"] for r in got.where("sr_file like '%c_test.csv'").select("`f1.1`").collect()} == {3.0, None, 6.0}
    long = series.csv_points(spark, str(folder), exclude=("c",))
    assert long.where("feature = 'f3' and series_id = 'f' and value = t").count() == 40
    assert {(r.t, r.value) for r in long.where("series_id = 'b' and feature = 'f2'").collect()} == {(0, 7.0), (1, 8.0)}


def test_one_header_reads_only_what_is_asked_for(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}_test.csv").write_text("f2,f1\n" + "\n".join(f"{i},{k}" for k in range(5)))
    got = read_by_header(spark, str(tmp_path), "f1 double")
    assert sorted(r.f1 for r in got.collect()) == sorted([float(k) for k in range(5)] * 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c1:string>" in plan and "Join" not in plan


def test_names_as_pandas_gives_them(spark, tmp_path):
    lines = ["a,b,c", "a,a,a", '"x,y",,"q""r"', "a,a.1,a", " a ,b"]
    for line in lines:
        path = tmp_path / "h.csv"
        path.write_text(line + "\n")
        assert header_names(line) == list(pd.read_csv(path).columns), line


def test_no_files_with_a_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert headers(spark, str(tmp_path)).collect() == []
    assert read_by_header(spark, str(tmp_path), "a double").collect() == []
