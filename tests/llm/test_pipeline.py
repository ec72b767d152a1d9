"""The pipeline: stages return the columns of documents, keep clean documents and drop what is planted."""

import random

import pytest

import corpus_pipeline


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(11)
    words = [f"term{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    item = text(40)
    clean = [(i, text(rng.randrange(30, 120))) for i in range(300)]
    junk = [(1000 + i, " ".join([rng.choice(words).upper() + "!!"] * 60)) for i in range(60)]
    copies = [(2000 + i, clean[i][1]) for i in range(20)]
    leaks = [(3000 + i, text(30) + " " + item + " " + text(20)) for i in range(10)]
    odd = [(None, text(50)), (4000, None), (4001, "")]
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "extra") for i, t in clean + junk + copies + leaks + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean[:200]] + [(i, 0, 0) for i, _ in junk[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]

    good = stages["quality"](spark, docs, corpus)
    kept = set(ids(good))
    assert good.columns == columns and sum(i < 300 for i in kept if i is not None) >= 297
    assert not {i for i in kept if i is not None and 1000 <= i < 1060}

    single = stages["near_duplicates"](spark, docs, corpus)
    left = ids(single)
    assert single.columns == columns and set(range(300)) <= set(left) and not {i for i in left if i is not None and 2000 <= i < 2020}
    assert len(left) == len(set(left)) and None in left

    safe = stages["decontamination"](spark, docs, corpus)
    left = ids(safe)
    assert safe.columns == columns and set(range(300)) <= set(left) and not {i for i in left if i is not None and 3000 <= i < 3010} and None in left

    mixed = stages["mixing"](spark, docs, corpus)
    assert mixed.columns == columns and max(ids(mixed).count(i) for i in range(50)) <= 3


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus).collect()
    n = len(out)
    assert sorted(r.slot for r in out) == list(range(n))
    left = {r.doc_id for r in out}
    assert not {i for i in left if i is not None and (1000 <= i < 1060 or 2000 <= i < 2020 or 3000 <= i < 3010)}
    assert len({i for i in left if i is not None and i < 300}) > 150


def test_decontamination_spares_texts_that_share_an_id(spark, tmp_path):
    """A contaminated text with a null or repeated id goes alone, with its own copies."""
    item = " ".join(f"term{i}" for i in range(40))
    rows = [(None, "head " + item), (None, "clean with a null id"), (None, "another clean one"), (None, None), (7, item), (7, item), (7, "clean with a repeated id"), (8, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "another clean one"), (0, "clean with a null id"), (7, "clean with a repeated id"), (8, "clean")]


def test_run_on_an_empty_table(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", columns), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
