"""Queries against their DuckDB twins on small tables."""

import random

import duckdb
import pytest
from conftest import varied

from tidewatch.llm import queries


def long_texts(seed):
    """Null and empty texts, null and repeated ids, copies, passages on either side of 400 bytes, wide characters, a text that repeats itself."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["tide", "watch", "naïve", "日本", "of", "a"]) + str(rng.randrange(50)) for _ in range(n))
    exact, shorter = "p" + words(90).encode()[:398].decode("utf-8", "ignore").ljust(398, "x"), words(40)
    texts = [None, "", "short", words(120), words(500)]
    texts += [words(30) + exact + words(30), words(10) + shorter + words(60), shorter + words(90), exact, exact + exact]
    texts += [texts[3], texts[5], texts[4] + words(20) + texts[4], "é" * 900]
    return [(None if i == 7 else 3 if i == 8 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [long_texts(1), long_texts(2), []], ids=["one", "two", "empty"])
def test_bytes_query_equals_its_sql(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = db.sql(queries.oracle_sql()["op8_suffix_dedup"])
    got = queries.op8_suffix_dedup(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    assert not rows or any(r[2] for r in want.fetchall())


def test_decontamination_query_equals_its_sql(spark, tmp_path):
    """Null ids and texts, items shorter than a shingle, items of one id, texts shorter than their item, changed words, capitals."""
    rng = random.Random(3)
    item = [f"Q{i}" for i in range(120)]
    items = [(0, " ".join(item[:30])), (1, " ".join(item[30:75])), (2, "tiny one"), (3, None), (4, " "), (None, " ".join(item[80:110] + item[80:90])), (0, " ".join(item[60:100]))]
    rows = [(None, items[0][1]), (1, None), (2, ""), (3, " ".join(item[:25])), (3, " ".join(item[30:75]).lower()), (4, "a TINY one")]
    for n in range(5, 60):
        piece = rng.choice([items[k][1] for k in (0, 1, 2, 5, 6)]).split()
        for _ in range(rng.randrange(0, 3)):
            piece[rng.randrange(len(piece))] = "changed"
        rows.append((n, " ".join([f"x{rng.randrange(20)}" for _ in range(rng.randrange(20))] + piece + ["end"] * rng.randrange(3))))
    db = duckdb.connect()
    for name, data, schema in (("documents", rows, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(data, schema).write.parquet(path)
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    want = db.sql(queries.oracle_sql()["op6_decontaminate"])
    got = queries.op6_decontaminate(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert len(got) > 20


@pytest.mark.parametrize("rows", [[(r[0] if r[0] != 9 else None, r[1]) for r in varied(6)], []], ids=["some", "empty"])
def test_simhash_query_equals_its_sql(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    near = [(900 + i, " ".join(["Long" + "é" * 40, *[f"w{k}" for k in range(400) if k != 7 * i]])) for i in range(6)] if rows else []
    spark.createDataFrame(rows + near, "doc_id long, text string").write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = db.sql(queries.oracle_sql()["op3_simhash"])
    got = queries.op3_simhash(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert not rows or len({r.component_id for r in got}) < len({r.doc_id for r in got})


@pytest.mark.parametrize("rows", [[(None if r[0] == 9 else -r[0] if r[0] == 12 else r[0], *r[1:]) for r in varied(8)], []], ids=["some", "empty"])
def test_mixing_query_equals_its_sql(spark, tmp_path, rows):
    labels = [(i, i % 2) for i in range(0, 40, 3)] + [(6, 1), (None, 1), (15, None)]
    db = duckdb.connect()
    for name, data, schema in (("documents", rows, "doc_id long, text string, source string"), ("labels", labels, "doc_id long, quality int")):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(data, schema).write.parquet(path)
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    want = db.sql(queries.oracle_sql()["op4_mixing"])
    got = queries.op4_mixing(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_bytes_query_takes_planted_passages_by_their_bytes(spark, tmp_path):
    """Passages of over 50 words in two texts each: n_removed tells those of 400 bytes from shorter ones, n_bytes is the text's length whatever it holds."""
    rng = random.Random(4)
    words = lambda n, letters: " ".join("".join(rng.choice("abcdefghij") for _ in range(letters)) for _ in range(n))
    passages = [words(51, 6), words(56, 6), words(58, 6)[:399], words(58, 6)[:400], words(81, 4)[:399], words(81, 4)[:400], words(120, 6)]
    assert all(len(p.split()) > 50 for p in passages)
    assert [len(p) for p in passages[2:6]] == [399, 400, 399, 400]
    rows, want = [], []
    for i, p in enumerate(passages):
        for k, (left, right) in enumerate(((" ", "\n"), ("\t", "\r"))):
            rows.append((2 * i + k, words(30, 7) + left + p + right + words(30, 7)))
            want.append((2 * i + k, len(rows[-1][1]), len(p) if len(p) >= 400 else 0))
    rows.append((99, words(130, 6)))
    want.append((99, len(rows[-1][1]), 0))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = queries.op8_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == want
