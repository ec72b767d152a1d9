"""Periodic runs against all lags of all places."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tidewatch.llm import queries
from tidewatch.llm.periodic import periodic_runs


def brute(words, least=6, repeats=4):
    """(start, length, period) of every run: at each lag, maximal stretches of equal words; a smaller period rules one out."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(least, repeats * q):
                stretch = words[start : start + length]
                if not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in found)


def loopy(seed):
    """Words with runs of several periods: nested, next to each other, cut off, with few different words."""
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(1, 8)):
        few = [chr(97 + k) for k in range(rng.choice([1, 2, 3, 12]))]
        unit = [rng.choice(few) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 33]))]
        if rng.random() < 0.4:
            unit = unit * rng.randrange(1, 6) + ["x"]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        out += [rng.choice("abcxyz") for _ in range(rng.randrange(4))]
    return out


def test_runs_equal_all_lags(spark, docs):
    texts = [(i, " ".join(loopy(i))) for i in range(120)]
    got = {r.doc_id: r for r in periodic_runs(docs(texts)).collect()}
    for i, text in texts:
        words, want = text.split(), brute(text.split())
        assert [tuple(r) for r in got[i].runs] == want
        gone = {x for s, n, q in want for x in range(s + q, s + n)}
        assert got[i].kept_text == " ".join(w for x, w in enumerate(words) if x not in gone)
        assert got[i].n_words == len(words)
    assert sum(len(r.runs) for r in got.values()) > 150


@pytest.mark.parametrize(("least", "repeats"), [(3, 3), (20, 4), (9, 5)])
def test_other_lengths(spark, docs, least, repeats):
    texts = [(i, " ".join(loopy(1000 + i))) for i in range(40)]
    for r in periodic_runs(docs(texts), least=least, repeats=repeats).collect():
        assert [tuple(x) for x in r.runs] == brute(texts[r.doc_id][1].split(), least, repeats)


def test_odd_rows(spark, docs):
    """Nulls, empty texts, repeated rows, null ids; equal neighbours in one batch never join up; an empty table."""
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "a a a"), (4, "a a a"), (5, "a a a"), (None, "a a a a a a"), (6, "é\té\né é  é é b")]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in periodic_runs(docs(rows, 1)).collect())
    run = (0, 6, [(0, 6, 1)], "a")
    assert got == sorted([run, run, (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 3, [], "a a a"), (4, 3, [], "a a a"), (5, 3, [], "a a a"), (6, 7, [(0, 6, 1)], "é b")])
    assert periodic_runs(docs([])).collect() == []
    (plain,) = periodic_runs(docs([(1, "no word comes back here at all")])).collect()
    assert (plain.n_words, plain.runs, plain.kept_text) == (7, [], "no word comes back here at all")
    with pytest.raises(ValueError):
        periodic_runs(docs([]), repeats=2)


def test_very_long_text(spark, docs):
    """Half a million words: a long period, a short one in its unit, and one word over and over."""
    rng = random.Random(4)
    unit = [f"u{rng.randrange(10**6)}" for _ in range(30_000)] + ["v", "w"] * 5
    words = [f"h{rng.randrange(10**6)}" for _ in range(1000)] + unit * 4 + ["z"] * 300_000 + [f"t{rng.randrange(10**6)}" for _ in range(80_000)]
    (row,) = periodic_runs(docs([(0, " ".join(words))], 1)).collect()
    short = [(1000 + (k + 1) * len(unit) - 10, 10, 2) for k in range(4)]
    assert [tuple(r) for r in row.runs] == sorted([(1000, 4 * len(unit), len(unit)), *short, (1000 + 4 * len(unit), 300_000, 1)])


def test_query_equals_plain_words_and_its_sql(spark, tmp_path):
    rows = [(i, " ".join(loopy(500 + i))) for i in range(60)]
    rows += [(None, "a b a b a b a b a b"), (61, None), (62, ""), (62, "c c c c c c c")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    want, planted = [], 0
    for doc_id, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines, kept = "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(kept)))
    assert planted > 2
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(str, db.sql(queries.oracle_sql()["op11_periodic_runs"]).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())) == sorted(map(str, want))
