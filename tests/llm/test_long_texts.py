"""Texts of 150,000 words among short ones, and a url of 200,000 characters."""

import random

import numpy as np
import pytest

from tidewatch.llm.decontaminate import contaminated
from tidewatch.llm.materialise import END_OF_TEXT, TOKENIZER, tokenizer, training_order
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.quality import importance_resample
from tidewatch.llm.simhash import near_duplicate_groups
from tidewatch.llm.similar import similar_groups
from tidewatch.llm.urls import Rule, url_filter


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    long = [f"w{rng.randrange(40_000)}" for _ in range(150_000)]
    item = " ".join(f"q{i}" for i in range(60))
    near = long.copy()
    for _ in range(500):
        near[rng.randrange(len(near))] = "changed"
    planted = long[:90_000] + item.split() + long[90_000:]
    short = [" ".join(f"s{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    texts = [*short, " ".join(long), " ".join(near), " ".join(long), " ".join(planted)]
    return [(i, t, f"s{i % 3}") for i, t in enumerate(texts)], item


def test_fingerprints_and_groups(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicate_groups(docs(rows[0]), ngram=3, radius=3).collect()}
    assert got[12] == got[14] and got[14][1] == 12 and len(got) == 16
    same = {r.doc_id: r.first_id for r in similar_groups(docs(rows[0])).collect()}
    assert [same[i] for i in (12, 13, 14, 15)] == [12] * 4 and all(same[i] == i for i in range(12))


def test_sizes_and_tokens(docs, rows):
    sizes = {r.doc_id: r.size for r in mix_sources(docs(rows[0])).collect()}
    assert sizes == {i: len(t.split()) for i, t, _ in rows[0]}
    encoding, back = tokenizer(TOKENIZER), {}
    for r in sorted(training_order(docs(rows[0]), length=1024).collect(), key=lambda r: (r.doc_id, r.seq_no)):
        back.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())
    for i, t, _ in rows[0]:
        assert back[i][-1] == END_OF_TEXT and encoding.decode(back[i][:-1]) == t


def test_a_passage_far_into_a_text(docs, spark, rows):
    items = spark.createDataFrame([(7, rows[1])], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity, r.start) for r in contaminated(docs(rows[0]), items).collect()] == [(15, 7, 1.0, 90_000)]


def test_quality_of_long_texts(docs, spark, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in importance_resample(docs(rows[0]), labels).collect()}
    assert len(got) == 16 and got[12] == got[14]


def test_a_very_long_url(spark):
    path = "/" + "ab/" * 66_000
    urls = spark.createDataFrame([(0, f"http://x.net/es{path}"), (1, f"http://y.org{path}?a={'1' * 1000}"), (2, "http://z.org/a")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter(urls, [Rule("net", "/es/", False)]).collect()}
    assert got[0].verdict == "block" and got[0].rule == "net/es/" and got[1].path == path and got[2].path == "/a"
