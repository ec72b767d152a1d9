"""Mixing and sharding: exact laws, water filling against a plain loop, reruns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import varied

from tidewatch.llm import mixing
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.shards import _hypergeometric, communication_matrix, shuffle_into_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, cap=3.0):
    """Shares by weight; whoever is above the cap stops there and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check_mix(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def test_targets_and_budgets(docs):
    rows = varied(2)
    got = mix_sources(docs(rows), per_octave=2).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    again = mix_sources(docs(rows, partitions=5), per_octave=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_capped_sources(docs):
    """Small sources with high weights reach the cap and their excess goes round."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (5, "b"), (3, "c"), (2, "c"), (40, "d"), (7, None), (0, "e")])]
    check_mix(rows, mix_sources(docs(rows)).collect())


def test_whole_documents_and_weights(docs, spark):
    rows = [(i, "w " * 10, "a" if i < 300 else "b") for i in range(400)]
    got = mix_sources(docs(rows), weights=spark.createDataFrame([(i, 9.0) for i in range(300, 350)], "doc_id long, weight double"), whole=True).collect()
    assert all(r.taken % r.size == 0 for r in got)
    b = [r for r in got if r.doc_id >= 300]
    assert abs(sum(r.taken for r in b) - b[0].target) <= 10
    # 2000 + 2/3 of the rest: whole epochs first, then mostly the heavy half
    extra = [r.doc_id for r in b if r.taken > min(x.taken for x in b)]
    if extra and len(extra) < 100:
        assert sum(i < 350 for i in extra) > len(extra) / 2


def test_takes_follow_the_weights(docs, spark):
    """Half of a source's 4,000 equal documents: with exponential keys the chance of one is 1 - exp(-weight * level)."""
    rows = [(i, "w " * 10, "a") for i in range(4000)] + [(5000 + i, "w " * 10, "b") for i in range(1000)]
    weights = spark.createDataFrame([(i, 3.0) for i in range(0, 4000, 2)] + [(i, 0.1) for i in range(1, 400, 2)], "doc_id long, weight double")
    for fineness in (None, 1):
        got = {r.doc_id: r.taken for r in mix_sources(docs(rows, extra=False), weights=weights, whole=True, per_octave=fineness).collect()}
        groups = {3.0: range(0, 4000, 2), 0.1: range(1, 400, 2), 1.0: range(401, 4000, 2)}
        low, high = 0.0, 50.0
        for _ in range(60):
            level = (low + high) / 2
            low, high = (level, high) if sum(len(g) * (1 - math.exp(-w * level)) for w, g in groups.items()) < 2000 else (low, level)
        assert sum(t for i, t in got.items() if i < 4000) == 20_000
        for w, g in groups.items():
            p = 1 - math.exp(-w * level)
            found = sum(got[i] > 0 for i in g)
            assert abs(found - len(g) * p) < 4.5 * math.sqrt(len(g) * p * (1 - p)), (w, found, len(g) * p)


def test_null_ids_repeats_and_empty_tables(docs):
    rows = [(None, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (None, None, None)]
    got = mix_sources(docs(rows)).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 9
    assert mix_sources(docs([])).count() == 0


def test_many_equal_rows_are_split(docs, monkeypatch):
    """Thousands of equal rows, ids null or not, take what they take when one task sorts them, and no part is large."""
    rows = varied(3) + [(None, "a b c", "x")] * 2500 + [(77_777, "d e", "x")] * 900 + [(None, None, "y")] * 1200
    parts, cut = [], mixing._cut_slices

    def seen(*args):
        out = cut(*args)
        parts.extend(out.groupBy("mix_group", "mix_slice", "mix_piece", "mix_part").count().collect())
        return out

    monkeypatch.setattr(mixing, "_cut_slices", seen)
    for whole in (False, True):
        monkeypatch.setattr(mixing, "HEAVY_ROWS", 10_000)
        plain = mix_sources(docs(rows), whole=whole).collect()
        assert not parts
        monkeypatch.setattr(mixing, "HEAVY_ROWS", 40)
        split = mix_sources(docs(rows, partitions=5), whole=whole).collect()
        assert sorted(map(repr, split)) == sorted(map(repr, plain))
        assert max(r["count"] for r in parts) < 250 and len({r.mix_part for r in parts}) > 20
        parts.clear()


def test_hypergeometric_law():
    rng = random.Random(1)
    n = 20_000
    found = Counter(_hypergeometric(rng, 6, 9, 5) for _ in range(n))
    from math import comb

    for k in range(6):
        p = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(found[k] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-4
    m = communication_matrix([5, 0, 900, 33], [313, 313, 312], 3)
    assert [sum(r) for r in m] == [5, 0, 900, 33] and [sum(c) for c in zip(*m)] == [313, 313, 312]
    with pytest.raises(ValueError):
        communication_matrix([1], [2], 0)


def test_shards_are_exact_and_gapless(docs):
    rows = varied(4, n=100)
    got = shuffle_into_shards(docs(rows), 7, slices=16).collect()
    text = {i: t for i, t, _ in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    slots = defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    again = shuffle_into_shards(docs(rows, partitions=6), 7, slices=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_shard_positions_look_uniform(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    got = shuffle_into_shards(df, 4, slices=32).collect()
    low = Counter(r.shard for r in got if r.doc_id < 10_000)
    assert all(abs(n - 2500) < 4 * 43 for n in low.values())
    early = sum(r.slot < 2500 for r in got if r.doc_id < 10_000)
    assert abs(early - 5000) < 4 * 50


def test_shards_of_null_repeated_and_few_rows(docs):
    got = shuffle_into_shards(docs([(None, None), (1, "x"), (1, "x")]), 24).collect()
    assert len(got) == 3 and all(r.slot == 0 for r in got) and len({r.shard for r in got}) == 3
    assert shuffle_into_shards(docs([]), 24).count() == 0


def test_equal_rows_are_dealt_to_many_slices(docs, spark):
    """Two thirds of the rows are one row without an id; shards are as even and gapless as ever, and no slice's sort holds them all."""
    from tidewatch.llm import shards
    from tidewatch.llm.scratch import Scratch

    rows = [(None, "same text")] * 4000 + [(i, f"text {i}") for i in range(2000)]
    kept = []

    class Kept(Scratch):
        def write(self, df):
            kept.append(super().write(df))
            return kept[-1]

        def drop(self, *tables):
            pass

    got = shards.shuffle_into_shards(docs(rows, 5), 24, scratch=Kept(spark)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 6000 and sorted(by) == list(range(24)) and all(sorted(v) == list(range(250)) for v in by.values())
    equal = Counter(r.shard for r in got if r.doc_id is None)
    assert all(120 < equal[s] < 215 for s in range(24)), "equal rows are spread over all shards"
    parts = kept[-1].groupBy("shard", "sh_part").count().agg({"count": "max"}).first()[0]
    assert parts < 20, "nor does the sort within a shard"
