"""Suffix arrays of byte strings in numpy: induced sorting and permuted common prefixes.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour. The leftmost S of each
run starts a substring; sorting those substrings orders their suffixes, and one scan up and one
scan down the buckets induces the order of all others. The scans go bucket by bucket: all entries
of a bucket, then those that it puts into itself, are moved in one array step each, so a scan takes
as many steps as there are bytes in use and equal bytes in a row, whatever the length.

The string of substring names has a large alphabet, for which bucket steps do not pay. It is ranked
by doubling: sort by (rank, rank one stride on), until all ranks differ.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S. The end of the string counts as smaller than any byte, so the last suffix is L."""
    n = len(t)
    apart = t[:-1] != t[1:]
    differs = np.flatnonzero(apart)
    s = np.zeros(n, bool)
    if len(differs):
        after = np.concatenate(([0], np.cumsum(apart)))  # places before it where neighbours differ
        known = after < len(differs)
        at = differs[after[known]]
        s[known] = t[at] < t[at + 1]
    return s


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the starts ``lms`` in order."""
    n = len(t)
    used = np.flatnonzero(np.bincount(t, minlength=256))
    by_byte = lambda x: {int(c): x[lo:hi] for c, lo, hi in _runs(x, t)}
    starts = by_byte(lms[np.argsort(t[lms], kind="stable")])
    larger: dict[int, list[np.ndarray]] = {int(c): [] for c in used}
    none = np.zeros(0, np.int64)

    def spread(into: dict[int, list[np.ndarray]], found: np.ndarray) -> None:
        found = found[np.argsort(t[found], kind="stable")]
        for c, lo, hi in _runs(found, t):
            into[c].append(found[lo:hi])

    def before(x: np.ndarray, want_s: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[is_s[x] == want_s]

    # Up: the last suffix is the smallest of its bucket, as nothing follows it.
    larger[int(t[n - 1])].append(np.array([n - 1]))
    for c in map(int, used):
        wave = np.concatenate(larger[c]) if larger[c] else none
        own = [wave]
        while len(wave):
            p = before(wave, False)
            same = t[p] == c
            spread(larger, p[~same])
            wave = p[same]
            own.append(wave)
        larger[c] = [np.concatenate(own)]
        if c in starts:
            spread(larger, before(starts[c], False))
    # Down: buckets are filled from their ends.
    smaller: dict[int, list[np.ndarray]] = {int(c): [] for c in used}
    for c in map(int, used[::-1]):
        wave = np.concatenate(smaller[c]) if smaller[c] else none
        own = [wave]
        while len(wave):
            p = before(wave, True)
            same = t[p] == c
            spread(smaller, p[~same])
            wave = p[same]
            own.append(wave)
        smaller[c] = [np.concatenate(own)]
        spread(smaller, before(larger[c][0][::-1], True))
    return np.concatenate([x for c in map(int, used) for x in (larger[c][0], smaller[c][0][::-1])])


def _runs(x: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """(byte, start, end) of each run of places with one byte."""
    if not len(x):
        return []
    k = t[x]
    edges = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(x)]))
    return [(int(k[a]), int(a), int(b)) for a, b in zip(edges, edges[1:])]


def _rank_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer string."""
    n = len(names)
    order = np.argsort(names)  # equal keys in any order: they share a rank
    ordered = names[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    stride = 1
    while rank.max(initial=0) < n - 1:
        key = rank * (n + 1)
        key[: n - stride] += rank[stride:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        stride *= 2
    return order


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Name of each start substring (up to the next start, inclusive), equal for equal substrings, rising in ``order``."""
    n, m = len(t), len(lms)
    length = np.empty(m, np.int64)
    length[:-1] = np.diff(lms) + 1
    length[-1] = n - lms[-1] + 1  # runs to the end: equal to no other
    place = np.empty(n, np.int64)
    place[lms] = np.arange(m)
    at = place[order]
    one, two = at[:-1], at[1:]
    same = (length[one] == length[two]) & (one != m - 1) & (two != m - 1)
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        differs = t[lms[one[live]] + k] != t[lms[two[live]] + k]
        same[live[differs]] = False
        k += 1
        live = live[~differs]
        live = live[length[one[live]] > k]
    names = np.empty(m, np.int64)
    names[at] = np.concatenate(([0], np.cumsum(~same)))
    return names


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte array in ascending order; a prefix comes before what it begins."""
    t = np.ascontiguousarray(t, np.uint8)
    n = len(t)
    if n < 2:
        return np.arange(n)
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms):
        by_substring = _induce(t, is_s, lms)
        starts = np.zeros(n, bool)
        starts[lms] = True
        names = _names(t, lms, by_substring[starts[by_substring]])
        lms = lms[_rank_by_doubling(names)]
    return _induce(t, is_s, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) by place: the suffix sorted just before, -1 for none, and the length of the common prefix, counted up to ``most``.

    A place is reducible if the bytes before it and before its neighbour agree: its value is then one
    less than that of the place to its left. Only irreducible places are compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (place > 0) & (phi > 0)
    # the left neighbour's value must be exact for this: it is, unless it was cut at ``most``
    reducible[inner] = t[place[inner] - 1] == t[phi[inner] - 1]
    heads = np.flatnonzero(~reducible)
    value = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(phi[heads] >= 0)
    k = 0
    limit = 2 * most + 1  # a head's value may pass on to ``most`` places after it
    a, b = heads[live], phi[heads[live]]
    eight = _eight_bytes(t)
    while len(live) and k < limit:
        # a string's end differs from any byte
        differ = eight[np.minimum(a + k, n)] ^ eight[np.minimum(b + k, n)]
        same = differ == 0
        same &= np.maximum(a, b) + k + 8 <= n
        done = ~same
        value[live[done]] = np.minimum(k + _leading_zero_bytes(differ[done]), n - np.maximum(a[done], b[done]))
        live, a, b = live[same], a[same], b[same]
        k += 8
    value[live] = _long_matches(t, a, b, k)
    run = np.cumsum(~reducible) - 1
    return phi, np.minimum(np.maximum(value[run] - (place - heads[run]), 0), most)


def _eight_bytes(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest; zeros after the end, and one more place."""
    padded = np.concatenate((t, np.zeros(9, np.uint8)))
    out = np.zeros(len(t) + 1, np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + len(out)]
    return out


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    count = np.zeros(len(x), np.int64)
    for j in range(8):
        count += x < np.uint64(1 << (8 * j)) if j else x == 0
    return count


def _long_matches(t: np.ndarray, a: np.ndarray, b: np.ndarray, done: int) -> np.ndarray:
    """Exact common prefixes of the few pairs that agree on ``done`` bytes already."""
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        k, step = done, 4096
        while True:
            u, v = t[x + k : x + k + step], t[y + k : y + k + step]
            size = min(len(u), len(v))
            bad = np.flatnonzero(u[:size] != v[:size])
            if len(bad):
                k += int(bad[0])
                break
            k += size
            if size < step:
                break
        out[i] = k
    return out
