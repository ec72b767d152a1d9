import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())])


@pytest.fixture
def docs(spark):
    """Makes a documents table, with extra columns whose names clash with the operators' own."""

    def make(rows, partitions=3, extra=True):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "a") for r in rows]
        df = spark.createDataFrame(rows, DOC).repartition(partitions)
        if extra:
            for name in ("size", "n_words", "tag", "did", "body", "shard", "rows", "m", "k", "kept", "print", "own_id", "taken"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


def varied(seed=0, n=40):
    """Texts with nulls, empty ones, copies, shared passages, odd spaces, wide characters and one long text."""
    import random

    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Émile", "naïve", "日本", "A", "b!"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = words(35)
    texts = [None, "", " \t\n ", "one", "two words", "two words"]
    for i in range(n):
        body = words(rng.randrange(1, 80))
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(body))
    texts += texts[10:14] * 2
    texts.append(" ".join(["same"] * 90))
    texts.append(" ".join(words(3000) + passage + words(50) + passage))
    return [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
