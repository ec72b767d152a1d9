"""Ranked search against scores of all pairs."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from tidewatch.llm import lexical, queries
from tidewatch.llm.lexical import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item row, rank, doc_id, score) over all pairs."""
    bags = [(d, terms(t)) for d, t in docs]
    many, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, (_, text) in enumerate(items):
        scores = []
        for d, bag in bags:
            m = 25 + (75 * len(bag) * many) // total if total else 0
            score = 0
            for t in terms(text):
                if tf := bag.count(t):
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, rank, None if s[1] else s[2], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


def sample(seed, many=250):
    """Texts of a skewed vocabulary, with long and short ones, copies, many repeats of a term, case and signs, null and empty texts."""
    rng = random.Random(seed)
    word = lambda: f"t{int(rng.paretovariate(0.7)) % 900}"
    texts = [" ".join(word() for _ in range(int(rng.paretovariate(0.8) * 6) % 700 + 1)) for _ in range(many)]
    texts += [None, "", "!? -", "Émile's naïve-日本 T7 t7", texts[3] + " t7" * 90, texts[5].upper(), "t1 " * 400]
    texts += [texts[8]] * 14
    docs = [(i, t) for i, t in enumerate(texts)]
    docs[20], docs[30] = (None, docs[20][1]), (4, docs[30][1])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    items += [(30, texts[8]), (31, None), (32, ""), (33, "émile NAÏVE 日本 É"), (None, "t7 t7 t7 t5"), (0, "t7 t3"), (35, "absent-word")]
    return docs, items


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS body", "1 AS query", "2 AS rank", "3 AS score", "4 AS did", "5 AS tag")


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_all_pairs(spark, seed):
    docs, items = sample(seed)
    got = ranked_search(table(spark, docs, "doc_id long, text string").repartition(3), table(spark, items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = [(items[i][0], *rest) for i, *rest in brute(docs, items)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    full = {(r.item_id, r.rank, r.doc_id, r.score) for r in got.where("item_id = 30").collect()}
    assert {(30, *x[1:]) for x in brute(docs, [(30, items[30][1])])} == full, "copies are ranked by ascending id"


def test_blocks_of_queries_and_other_k(spark):
    docs, items = sample(5, 80)
    items = [(i, t) for i, (_, t) in enumerate(items)]
    got = ranked_search(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"), k=3, block=9)
    assert sorted((r.item_id, r.rank, r.score) for r in got.collect()) == sorted((i, rank, s) for i, rank, _, s in brute(docs, items, 3))


def test_empty_tables(spark):
    docs, items = sample(1, 40)
    none = lambda kind: table(spark, [], kind)
    assert ranked_search(none("doc_id long, text string"), table(spark, items, "item_id long, text string")).collect() == []
    assert ranked_search(table(spark, docs, "doc_id long, text string"), none("item_id long, text string")).collect() == []
    assert ranked_search(table(spark, [(1, "..."), (2, None)], "doc_id long, text string"), table(spark, items, "item_id long, text string")).collect() == []


def test_very_long_text(spark):
    """A text of 300,000 terms among short ones: signatures of another width, repeats far up the levels."""
    rng = random.Random(3)
    long = [f"u{i}" for i in range(120_000)] + ["t3"] * 60_000 + [f"u{rng.randrange(10**6)}" for _ in range(120_000)]
    docs = [(0, " ".join(long))] + [(i, " ".join(f"t{rng.randrange(40)}" for _ in range(9))) for i in range(1, 60)]
    items = [(0, "t3 u7 u119999"), (1, "t3 t4 t5"), (2, "u5 t39")]
    got = ranked_search(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items))


def test_bounds_are_never_below_the_score():
    docs, items = sample(9, 120)
    import pyarrow as pa

    q = lexical._Queries.of(sorted(((i, t) for i, t in enumerate(x[1] for x in items) if t), key=lambda r: r[0]))
    texts = [t for _, t in docs]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())], ["did", "tag", "body"])
    bags = [lexical.term_counts(t) for t in texts]
    many, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    ones = np.ones(len(q.vocabulary), np.int64)
    corpus = lexical._Corpus(many, total, ones, 1000 * ones)
    seen = 0
    for out in lexical._index(q.vocabulary)(iter([batch])):
        for block in out.to_pylist():
            for part, bounds in lexical._bounds(block, q, corpus):
                for at, d in enumerate(block["dids"][part]):
                    for x, counts in enumerate(q.counts):
                        exact = sum(n * 1000 * lexical._gain(bags[d][t], corpus.length(sum(bags[d].values()))) for t, n in counts.items() if bags[d][t])
                        assert bounds[x, at] >= exact
                        seen += bounds[x, at] < 1.2 * exact
    assert seen > 1000


@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_its_sql(spark, tmp_path, empty):
    docs, items = sample(7)
    docs = [(1000 if d is None else 1001 if i == 30 else d, t) for i, (d, t) in enumerate(docs)]
    db = duckdb.connect()
    for name, rows, kind in (("documents", [] if empty else docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, kind).write.parquet(path)
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    want = db.sql(queries.oracle_sql()["op12_lexical_search"])
    got = queries.op12_lexical_search(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert empty or len(got) > 200
