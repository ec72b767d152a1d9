"""Substring and byte dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import varied

from tidewatch.llm import text
from tidewatch.llm.byte_dedup import remove_repeated_bytes
from tidewatch.llm.substring_dedup import remove_repeated_windows
from tidewatch.llm.suffix import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, window):
    first, out = {}, []
    texts = sorted(((i, WORD.findall(t or "")) for i, t, *_ in rows), key=lambda x: x[0])
    gone = {}
    for i, w in texts:
        covered = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                covered.update(range(k, k + window))
            else:
                first[key] = (i, k)
        gone[i] = covered
        out.append((i, len(w), len(covered), " ".join(x for j, x in enumerate(w) if j not in covered)))
    return out


@pytest.mark.parametrize("window,gram", [(20, 8), (5, 5), (7, 1), (1, 1)])
def test_windows_against_brute_force(docs, window, gram):
    rows = varied()
    got = remove_repeated_windows(docs(rows), window=window, gram=gram).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_words(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_windows_of_null_and_repeated_ids(docs):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, passage), (1, passage), (1, passage), (2, "x " + passage), (2, passage + " y"), (None, None)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.kept_text) for r in remove_repeated_windows(docs(rows)).collect())
    assert got == [(1, passage), (1, passage), (2, "x"), (2, "y"), (99, ""), (99, "")]


def test_windows_of_texts_that_share_an_id_are_apart(docs):
    """A passage that one text repeats stays in another text of the same (or null) id that has it once, at the same place."""
    passage = " ".join(f"p{i}" for i in range(25))
    twice, once = f"{passage} {passage}", " ".join(f"q{i}" for i in range(25)) + " " + passage
    rows = [(None, twice), (None, once), (None, once), (4, twice.upper()), (4, once.upper())]
    got = sorted((r.doc_id or 0, r.kept_text) for r in remove_repeated_windows(docs(rows)).collect())
    assert got == sorted([(0, passage), (0, once), (0, once), (4, passage.upper()), (4, once.upper())])


def test_windows_of_an_empty_table(docs):
    assert remove_repeated_windows(docs([])).count() == 0


def brute_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        keep = np.ones(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                keep[k : k + length] = False
        edge = np.diff(np.concatenate(([0], ~keep, [0])).astype(int))
        out.append((i, len(b), int((~keep).sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[keep])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram,limit", [(60, 10, 1024), (60, 10, 2), (16, 16, 3), (40, 4, 1)])
def test_bytes_against_brute_force(docs, length, gram, limit):
    """A small group limit sends most groups through the splitting of hot anchors."""
    rows = varied(3)
    got = remove_repeated_bytes(docs(rows), length=length, gram=gram, group_limit=limit).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes(rows, length)


@pytest.mark.parametrize("chunk", [1, 50, 300])
def test_bytes_of_texts_in_pieces(docs, chunk):
    """Texts longer than a chunk come in overlapping pieces."""
    rows = varied(4)
    got = remove_repeated_bytes(docs(rows), length=60, gram=10, chunk=chunk).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes(rows, 60)


def test_anchors_of_more_places_than_bits(monkeypatch):
    grams = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    keep = grams & np.uint64(0xFFFFFFFF << 32)
    want = [i + int(np.argmin(keep[i : i + 7])) for i in range(len(grams) - 6)]
    for bits in (26, 9):
        monkeypatch.setattr(text, "PLACE_BITS", bits)
        assert text.anchors(grams, 7).tolist() == want


def test_bytes_of_null_and_repeated_ids(docs):
    long = "abcdefghij" * 3 + "klm"
    got = remove_repeated_bytes(docs([(None, long + "1"), (5, "x" + long), (5, "unlike"), (7, "z" * 40), (None, None)]), length=30, gram=5).collect()
    assert sorted(bytes(r.kept) for r in got) == [b"", b"", b"1", b"unlike", b"x"]
    assert remove_repeated_bytes(docs([]), length=30, gram=5).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for trial in range(200):
        t = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 50)).astype(np.uint8)
        if trial % 3 == 0 and len(t) > 10:
            t[len(t) // 2 : len(t) // 2 + len(t) // 3] = t[: len(t) // 3]
        b = t.tobytes()
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        phi, plcp = common_prefixes(t, sa, 7)
        for r in range(1, len(sa)):
            i, j = int(sa[r]), int(sa[r - 1])
            k = 0
            while max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            assert phi[i] == j and plcp[i] == min(k, 7)


def test_bytes_of_many_equal_rows(docs):
    """A thousand rows of one text without an id, and a thousand with one id: lists and pieces stay those of one row."""
    import random

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    first, second, alone, passage = text(3000), text(2500), text(2000), text(450)
    rows = [(None, first + passage)] * 1000 + [(7, second)] * 1000 + [(8, alone + passage), (9, text(900)), (None, passage + text(300))]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans)) for r in remove_repeated_bytes(docs(rows)).collect())
    assert got == {(None, 3450, 3450, 1): 1000, (7, 2500, 2500, 1): 1000, (8, 2450, 450, 1): 1, (9, 900, 0, 0): 1, (None, 750, 450, 1): 1}
