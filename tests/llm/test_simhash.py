"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash
from conftest import varied

from tidewatch.llm.components import components
from tidewatch.llm.scratch import Scratch
from tidewatch.llm.simhash import linked_labels, links, near_duplicate_groups


def brute_print(text, n=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_roots(values, names, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(values))]
    return [min(n for n, r in zip(names, roots) if r == roots[i]) for i in range(len(values))]


def test_groups_against_all_pairs(docs):
    rows = varied(1) + [(500, " ".join(f"k{i}" for i in range(400)), "a"), (501, " ".join(f"k{i}" for i in range(399)), "a")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicate_groups(docs(rows)).collect())
    prints = [brute_print(t) for _, t, *_ in rows]
    want = brute_roots(prints, [r[0] for r in rows], 3)
    assert got == sorted((r[0], f"{p:016x}", w) for r, p, w in zip(rows, prints, want))


@pytest.mark.parametrize("limit,radius", [(20_000, 3), (25, 3), (20_000, 7), (20_000, 0)])
def test_links_keep_all_components(spark, limit, radius):
    """Fingerprints that crowd into few buckets, with buckets split down to a few nodes."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {0, (1 << 64) - 1}
    for i in range(150):
        v = int(base[i % 6])
        for b in rng.integers(0, 64 if i % 2 else 12, rng.integers(0, 5)):
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    scratch = Scratch(spark)
    nodes = spark.createDataFrame([(v,) for v in signed], "print long")
    roots = {r.node: r.root for r in components(links(nodes, radius, scratch, limit), scratch).collect()}
    assert [roots.get(v, v) for v in signed] == brute_roots(values, signed, radius)


def test_bit_sliced_labels_stay_in_their_run():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 16, 500, dtype=np.uint64)
    run = np.sort(rng.integers(0, 9, 500))
    label = linked_labels(prints, run, 2, pairs_at_once=64)
    for r in range(9):
        at = np.flatnonzero(run == r)
        want = brute_roots([int(x) for x in prints[at]], at.tolist(), 2)
        assert label[at].tolist() == want


def test_components_of_odd_graphs(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 7), (10, 9), (9, 8), (8, 11), (None, 4), (1, 2)] + [(100, x) for x in range(101, 160)] + [(x, x + 1) for x in range(200, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: 1 for x in (1, 2, 3)} | {x: 8 for x in (8, 9, 10, 11)} | {x: 100 for x in range(100, 160)} | {x: 200 for x in range(200, 261)}


def test_null_ids_repeated_rows_and_empty_tables(docs):
    got = near_duplicate_groups(docs([(None, "a b c d"), (3, "A B C D"), (3, "a b c d"), (None, "alone here now then"), (4, None), (5, "")])).collect()
    by = sorted((r.doc_id is None, r.doc_id or 0, r.component_id if r.component_id is not None else -1) for r in got)
    assert by == [(False, 3, 3), (False, 3, 3), (False, 4, 4), (False, 5, 4), (True, 0, -1), (True, 0, 3)]
    assert near_duplicate_groups(docs([])).count() == 0
