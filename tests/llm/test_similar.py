"""Wide-SimHash groups against exact similarities of all pairs."""

import random

import numpy as np
import pytest
from conftest import varied

from tidewatch.llm.similar import bit_radius, similar_groups
from tidewatch.llm.simhash import linked_labels


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), round(len(out) * share)):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture
def near():
    rng = random.Random(7)
    rows = []
    for base in range(60):
        words = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        rows += [" ".join(words), edited(rng, words, 0.005), edited(rng, words, 0.018), edited(rng, words, 0.1)]
    return [(i, t) for i, t in enumerate(rows)] + [(i + 1000, t) for i, t, *_ in varied(3)]


@pytest.mark.parametrize("block", [8192, 7])
def test_groups_follow_similarity(docs, near, block):
    got = {r.doc_id: r.first_id for r in similar_groups(docs(near), block=block).collect()}
    assert len(got) == len(near)
    sets = [(i, shingles(t)) for i, t in near]
    missed = wrong = close = 0
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            value = jaccard(a, b)
            if value >= 0.8:
                close += 1
                missed += got[i] != got[j]
            if value >= 0.86:
                assert got[i] == got[j]
            if i // 4 != j // 4 and value < 0.5:
                wrong += got[i] == got[j]
    assert close > 100 and missed <= close * 0.02 and wrong == 0
    assert all(got[i] == i for i in range(3, 240, 4))  # a tenth of the words changed: a similarity under 0.5


def test_bit_sliced_distance_of_wide_fingerprints():
    """All radii, with distances that run past the counters' range, against plain bit counts."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, (150, 3), dtype=np.uint64)
    prints[75:] = prints[:75]
    for x in range(75, 150):
        for b in rng.integers(0, 192, x - 75):
            prints[x, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    apart = (bits[:, None] != bits[None]).sum(axis=2)
    for radius in (0, 1, 5, 20, 40):
        label = linked_labels(prints, np.zeros(150, int), radius)
        reach = apart <= radius
        for _ in range(8):
            reach = reach @ reach
        assert ((label[:, None] == label[None]) == reach).all()


def test_radius():
    assert bit_radius(0.8, 512) == 95 and bit_radius(1.0, 512) == 0


def test_null_ids_repeated_rows_and_empty_tables(docs):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (3, long.upper()), (3, long), (3, "another text of the same id"), (None, "alone here"), (None, "alone too"), (4, None), (5, " ")]
    got = sorted((r.doc_id or 0, r.first_id or 0) for r in similar_groups(docs(rows)).collect())
    assert got == [(0, 0), (0, 0), (0, 3), (3, 3), (3, 3), (3, 3), (4, 4), (5, 4)]
    assert similar_groups(docs([])).count() == 0


def test_repeats_count_once(docs):
    """Texts with nearly equal shingle sets are one group however often a line of theirs repeats."""
    rng = random.Random(3)
    rows = []
    for base in range(8):
        body, line = ([f"v{rng.randrange(10**6)}" for _ in range(n)] for n in (304, 14))
        rows += [(2 * base, " ".join(body + line)), (2 * base + 1, " ".join(body + line * 20))]
        assert jaccard(shingles(rows[-1][1]), shingles(rows[-2][1])) > 0.9
    got = {r.doc_id: r.first_id for r in similar_groups(docs(rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(16)}


@pytest.mark.parametrize("block,members", [(8192, 512), (7, 512), (8192, 3)])
def test_groups_are_the_exact_components(docs, block, members):
    """Many pairs just below and just above 0.8: groups are the components of the exact links, no more and no fewer."""
    rng = random.Random(23)
    rows = []
    for base in range(12):
        words = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(250, 400))]
        rows += [edited(rng, words, share) for share in (0, 0.004, 0.008, 0.012, 0.016, 0.02, 0.024, 0.028, 0.032, 0.04, 0.04, 0.04)]
    sets = [shingles(t) for t in rows]
    root, below = list(range(len(rows))), 0
    for x, a in enumerate(sets):
        for y in range(x):
            value = jaccard(a, sets[y])
            below += 0.7 <= value < 0.8
            if value >= 0.8:
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
    assert below > 100 and len(set(root)) > 30
    got = {r.doc_id: r.first_id for r in similar_groups(docs(list(enumerate(rows))), block=block, members=members).collect()}
    assert [got[i] for i in range(len(rows))] == root
