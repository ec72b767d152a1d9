"""Media round trips, token order, decontamination, quality and url filters."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import varied

from tidewatch.llm import media
from tidewatch.llm import text as text_tools
from tidewatch.llm.decontaminate import contaminated
from tidewatch.llm.materialise import END_OF_TEXT, TOKENIZER, Feistel, resume, shard_pages, tokenizer, training_order, write_shards, written_order
from tidewatch.llm.quality import best_threshold, importance_resample, top_k
from tidewatch.llm.urls import Rule, url_filter


# --- media


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (7, 64), (200, 64), (33, 5)])
def test_png_round_trip(shape):
    rng = np.random.default_rng(1)
    for kind in ("noise", "flat", "ramp"):
        x = {"noise": rng.integers(0, 256, shape), "flat": np.full(shape, 7), "ramp": np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 5) % 256}[kind].astype(np.uint8)
        png = media.write_png(x)
        assert (media.read_png(png) == x).all()


def test_all_line_filters_are_undone():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (12, 9)).astype(np.int64)
    lines = []
    for y in range(12):
        kind, row = [0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 0][y], []
        for i in range(9):
            a = int(x[y, i - 1]) if i else 0
            b = int(x[y - 1, i]) if y else 0
            c = int(x[y - 1, i - 1]) if i and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((int(x[y, i]) - [0, a, b, (a + b) // 2, near][kind]) % 256)
        lines.append([kind, *row])
    assert (media._unfilter(np.array(lines, np.uint8)) == x).all()


def test_damage_is_found():
    png = media.write_png(np.arange(640, dtype=np.uint8).reshape(10, 64))
    for at in (3, 20, 45, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bytes(bad))
    for cut in (10, 40, len(png) - 5):
        with pytest.raises(ValueError):
            media.read_png(png[:cut])


def test_media_columns(docs):
    rows = varied(5) + [(None, "a", "s")]
    got = media.media_columns(docs(rows)).collect()
    text = dict((r[0], r[1]) for r in rows)
    by_text = collections.defaultdict(set)
    assert len(got) == len(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert media.read_png(bytes(r.media)).tobytes() == want
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(want), len(r.media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(want).hexdigest(), hashlib.sha256(bytes(r.media)).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-64:])
        by_text[raw].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_columns(docs([])).count() == 0


# --- token order


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = Feistel(n, 9)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (f.index(slots) == np.arange(n)).all()


def test_training_order_round_trip(docs, spark, tmp_path):
    rows = varied(7)
    encoding = tokenizer(TOKENIZER)
    order = training_order(docs(rows), length=64, per_shard=16)
    got = order.collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    assert all(r.shard == r.slot // 16 and r.position == r.slot % 16 and len(r.tokens) == 128 for r in got)
    back = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.seq_no)):
        ids = np.frombuffer(r.tokens, "<u2")
        assert not ids[r.n_tokens :].any()
        back[r.doc_id] += ids[: r.n_tokens].tolist()
    for i, t, _ in rows:
        assert back[i][-1] == END_OF_TEXT and encoding.decode(back[i][:-1]) == (t or "")
    path = str(tmp_path / "shards")
    write_shards(order, path, 16, page=6)
    for slot in (0, 16, 21, n - 1, n):
        later = resume(spark, path, slot, 16).collect()
        assert sorted(map(tuple, later)) == sorted(tuple(r) for r in got if r.slot >= slot)
    # record r of a page lies at byte r times the stride, and pages follow each other
    by_slot = {r.slot: bytes(r.tokens) for r in got}
    pages = spark.read.parquet(path).collect()
    for p in pages:
        assert zlib.crc32(p.payload) == p.crc32 and len(p.payload) == p.records * 128 and p.records <= 6
        assert p.shard == p.first_slot // 16 == (p.first_slot + p.records - 1) // 16
        assert all(bytes(p.payload[128 * r : 128 * r + 128]) == by_slot[p.first_slot + r] for r in range(p.records))
    assert sorted(s for p in pages for s in range(p.first_slot, p.first_slot + p.records)) == list(range(n))
    (whole,) = shard_pages(order.where("shard = 1"), 16).collect()
    assert bytes(whole.payload) == b"".join(by_slot[s] for s in range(16, 32))


def test_training_order_of_null_and_no_rows(docs):
    got = training_order(docs([(None, None), (1, ""), (1, "")]), length=8).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2] and all(r.n_tokens == 1 for r in got)
    assert training_order(docs([]), length=8).count() == 0
    assert written_order(docs([]), length=8).count() == 0


def test_slots_are_whole_when_tasks_write_several_files(docs, spark):
    rows = varied(7)
    want = collections.Counter(bytes(r.tokens) for r in training_order(docs(rows), length=64).collect())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "5")
    try:
        got = written_order(docs(rows), length=64, per_shard=16)
        assert len(got.inputFiles()) > 3
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(r.slot for r in got) == list(range(sum(want.values())))
    assert collections.Counter(bytes(r.tokens) for r in got) == want and all(r.shard == r.slot // 16 for r in got)


# --- decontamination


def brute_matches(rows, items, least=0.8, k=5):
    bag = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    lower = lambda t: [w.lower() for w in (t or "").encode().split()]
    out = {}
    for d, t, *_ in rows:
        w = lower(t)
        for i, x in items:
            v = lower(x)
            if not v or not w:
                continue
            s, n = min(k, len(v)), min(len(v), len(w))
            b = bag(v, s)
            for at in range(len(w) - n + 1):
                a = bag(w[at : at + n], s)
                low = sum(min(c, b[y]) for y, c in a.items())
                value = low / (sum(a.values()) + sum(b.values()) - low)
                if value >= least and value > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (value, at)
    return out


def test_decontamination_against_all_windows(docs, spark):
    import random

    rng = random.Random(8)
    item = [f"q{i}" for i in range(200)]
    items = [(0, " ".join(item[:30])), (1, " ".join(item[30:75])), (2, "tiny one"), (3, None), (4, ""), (5, " ".join(item[80:110] + item[80:90])), (6, " ".join(item[:30]))]
    rows = varied(9)
    for n in range(60):
        body = [rng.choice(["x", "y", "z", "w"]) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 60))]
        piece = (items[rng.choice([0, 1, 2, 5])][1]).split()
        for _ in range(rng.randrange(0, 3)):
            piece[rng.randrange(len(piece))] = "changed"
        if n % 4 == 0:
            piece = [p.upper() for p in piece]
        at = rng.randrange(len(body) + 1)
        rows.append((1000 + n, " ".join(body[:at] + piece + body[at:]), "s"))
    got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_matches(rows, [i for i in items])
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got} == {k: (round(v[0], 9), v[1]) for k, v in want.items()}
    assert len(got) == len(want) > 20
    blocks = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block=3)
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == sorted(want)
    assert contaminated(docs([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contaminated(docs(rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("case", ["in the text", "in the item", "in both"])
def test_decontamination_finds_repeated_words(docs, spark, case):
    """Runs of one word make most of a bag's weight: 120 planted pairs at a weighted similarity from 0.8 up, each to be found."""
    import random

    rng = random.Random(case)
    items, rows = [], []
    while len(items) < 120:
        i = len(items)
        plain = [f"a{i}x{j}" for j in range(rng.randrange(25, 60))]
        run, other = [f"r{i}"] * rng.randrange(8, 30), [f"s{i}x{j}" for j in range(30)]
        n = rng.randrange(1, 6)  # words of the run that differ
        looped, mixed = plain + run, plain + run[n:] + (other[:n] if case != "in both" else [f"t{i}"] * n)
        if case == "in the item":
            short = run[: rng.randrange(1, 3)]
            looped, mixed = plain + short * 5, plain + short * 5 + short
            looped, mixed = looped + other[:1], mixed[: len(looped) + 1]
        item, text = (mixed, looped) if case == "in the text" else (looped, mixed)
        pair = brute_matches([(i, " ".join(text))], [(i, " ".join(item))])
        if pair:
            items.append((i, " ".join(item)))
            rows.append((i, " ".join([f"u{rng.randrange(90)}" for _ in range(rng.randrange(20))] + text)))
    want = {(d, i): (round(v[0], 9), v[1]) for d, i in ((k, k) for k in range(120)) for v in brute_matches([rows[d]], [items[i]]).values()}
    got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got} == want
    assert len(want) == 120


def test_decontamination_of_a_run_replaced(docs, spark):
    """An item of distinct words and a run of one word, in 40 texts with another word in the run's place, at 0.82 and 0.81."""
    for many, run in ((60, 10), (100, 16)):
        items = [(0, " ".join([f"q{j}" for j in range(many)] + ["z"] * run))]
        rows = [(i, " ".join([f"b{i}x{j}" for j in range(9)] + [f"q{j}" for j in range(many)] + [f"y{i}"] * run + ["end"])) for i in range(40)]
        want = brute_matches(rows, items)
        got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v[0], 9) for k, v in want.items()}


def test_window_fingerprints_number_their_repeats():
    from tidewatch.llm.decontaminate import _bits, _numbered, _simhash, window_prints

    rng = np.random.default_rng(2)
    grams = rng.integers(0, 9, 400).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    start = np.sort(rng.choice(360, 150, replace=False))
    size = np.where(start < 200, 31, 40)
    want = [_simhash(_bits(_numbered(grams[a : a + m])).sum(axis=0, dtype=np.int64)[None], np.array([m]))[0] for a, m in zip(start, size)]
    assert (window_prints(grams, start, size) == np.stack(want)).all()


# --- quality


def test_quality_on_held_out_documents(docs, spark):
    import random

    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 80))).capitalize() + "."
    junk = lambda: rng.choice([" ".join([rng.choice(words)] * 40), " ".join(rng.choice(words).upper() + "!!" for _ in range(40)), " ".join(rng.choice(words) + rng.choice(["###", "$$$"]) for _ in range(40))])
    rows = [(i, junk() if i % 6 == 0 else good(), "s") for i in range(900)] + [(5000, None, "s"), (None, good(), "s"), (5001, "", "s")]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(450)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance_resample(docs(rows), labels).collect()
    assert len(got) == len(rows)
    test = [r for r in got if r.doc_id is not None and 450 <= r.doc_id < 900]
    assert sum(r.kept for r in test if r.doc_id % 6) >= 0.99 * sum(1 for r in test if r.doc_id % 6)
    assert sum(r.kept for r in test if r.doc_id % 6 == 0) <= 0.02 * len(test)
    again = importance_resample(docs(rows, partitions=5), labels).collect()
    key = lambda x: sorted((r.doc_id if r.doc_id is not None else -1, r.log_weight, r.kept) for r in x)
    assert key(got) == key(again)
    exact = importance_resample(docs(rows), labels, k=100).collect()
    assert sum(r.kept for r in exact) == 100


ALL64 = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & ALL64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & ALL64
    return h ^ (h >> 31)


def plain_buckets(text, buckets):
    """Buckets of all n-grams of a text, one by one: words (1, 2) and shapes of words (1 to 3)."""
    raw = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw]
    words = [plain_mix(sum((c + 1) * pow(text_tools.BASE_A, i, 1 << 64) for i, c in enumerate(w)) & ALL64) for w in lower]
    shapes = []
    for i, w in enumerate(raw):
        upper = sum(65 <= c <= 90 for c in w)
        case = 0 if not upper else 1 if upper == 1 and 65 <= w[0] <= 90 else 3 if upper * 2 >= len(w) else 2
        digits = sum(48 <= c <= 57 for c in w)
        symbols = sum(33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()" for c in w)
        again = (i > 0 and lower[i] == lower[i - 1]) + 2 * (i > 1 and lower[i] == lower[i - 2])
        code = min(len(w), 23) // 3
        for part, base in ((case, 4), (min(digits, 2), 3), (min(symbols, 3), 4), (w[-1] in b".?!", 2), (again, 4)):
            code = code * base + int(part)
        shapes.append(code)
    out = []
    for salt, (stream, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        for i in range(len(stream) - n + 1):
            h = salt + 1
            for x in stream[i : i + n]:
                h = plain_mix((h * 0x9E3779B97F4A7C15 + x) & ALL64)
            out.append(h % buckets)
    return out


def test_quality_against_plain_counts(docs, spark):
    """Log weights, Gumbel keys and the k kept, against a version without arrays; with nulls, copies and repeated rows."""
    rows = varied(11) + [(None, "Null ID here.", "s"), (7, "again", "s"), (7, "again", "s")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 30)] + [(400, 1), (3, None)]
    got = importance_resample(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"), buckets=64, k=20).collect()
    held = {r[0] for r in spark.createDataFrame(labels, "id long, q int").selectExpr("id", "pmod(xxhash64(42, id), 5) = 0 AS held").collect() if r.held}
    good = {i for i, q in labels if q} - held
    raw, target = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        raw.update(found := plain_buckets(t, 64))
        if i in good:
            target.update(found)
    log_ratio = [math.log((target[b] + 1) / (target.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in range(64)]
    by_id = lambda pairs: sorted((-1 if i is None else i, w) for i, w in pairs)
    want = by_id((i, sum(log_ratio[b] for b in plain_buckets(t, 64))) for i, t, *_ in rows)
    found = by_id((r.doc_id, r.log_weight) for r in got)
    assert [i for i, _ in found] == [i for i, _ in want] and all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(found, want))
    again = spark.createDataFrame([(r.doc_id, r.tag, r.sample_key, r.log_weight) for r in got], "id long, tag long, k double, w double")
    assert again.where("abs(k - (w - ln(-ln((shiftrightunsigned(xxhash64(43, id, tag), 12) + 0.5D) / pow(2D, 52))))) > 1e-9").count() == 0
    order = sorted(got, key=lambda r: -r.sample_key)
    assert sum(r.kept for r in got) == 20 and min(r.sample_key for r in got if r.kept) >= order[19].sample_key


def test_quality_without_labels_or_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = importance_resample(docs([(1, "a b"), (1, "a b"), (None, None)]), none).collect()
    assert len(got) == 3 and all(r.kept and r.log_weight == 0 for r in got)
    assert importance_resample(docs([]), none).count() == 0


def test_top_k_and_threshold(spark):
    rows = [(i, float(x)) for i, x in enumerate([3, 3, 3, -1, 0, 1e9, -1e9, 0.001, 3, 2])]
    df = spark.createDataFrame(rows, "id long, v double")
    order = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for k in range(0, 12):
        assert {r.id for r in top_k(df, k, "v", ["id"]).collect() if r.kept} == set(order[:k])
        narrow = {r.id for r in top_k(df, k, "v", ["id"], hold=1).collect() if r.kept}
        assert sorted(dict(rows)[i] for i in narrow) == sorted(dict(rows)[i] for i in order[:k])
    assert best_threshold([1.0, 2.0, 3.0, 4.0], [False, False, True, True]) == 2.5
    assert best_threshold([1.0], [True]) == float("-inf")


# --- urls

RULES = [Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True), Rule("net", "/es/", False), Rule("net", "/fr/", False)]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?y#z", "http://www.example.com/en/1", "http://example.com/fr/", "http://example.com", "http://x.net/es/1", "http://x.net/fr/1", "http://x.net/en/1",
            "http://notcom/", "http://a.com?x=/", "ftp://b.org/q://c.com/", "http://É.com/", "HTTP://x.net/fr/2\n3", "http://x.net/es/1"]
    pages = spark.createDataFrame([(i if i else None, u, "h", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, label string")
    got = url_filter(pages, RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = brute_url(urls[r.page_id or 0])
        rule = brute_rule(host, path)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule.name if rule else None)
        if rule:
            assert r.verdict == ("allow" if rule.allow else "block")
        assert r.verdict in ("allow", "block")
    assert url_filter(pages.limit(0), RULES).count() == 0
    only = url_filter(pages.where("url LIKE '%.net/es%' OR url = ''"), RULES)
    assert {r.verdict for r in only.collect()} == {"block"}


def test_url_trees_on_held_out_labels(spark):
    import random

    rng = random.Random(3)
    spam = lambda: f"http://{''.join(rng.choice('0123456789x-') for _ in range(18))}.org/{rng.randrange(10**6)}?a=1&b=2&c=3"
    clean = lambda: f"https://{rng.choice(['blog', 'news', 'docs'])}.site{rng.choice('abc')}.org/read/page"
    data = [(i, spam() if i % 2 else clean()) for i in range(400)]
    labelled = spark.createDataFrame([(u, i % 2) for i, u in data[:200]], "url string, label int")
    got = url_filter(spark.createDataFrame(data[200:], "page_id long, url string"), RULES, labelled).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) >= 0.95 * len(got)


def test_items_with_a_null_id_match_under_a_null_id(spark, docs):
    passages = [" ".join(f"{c}{i}" for i in range(30)) for c in "xyz"]
    rows = [(i, f"head {p} tail") for i, p in enumerate(passages)] + [(None, passages[1]), (9, "clean")]
    items = [(None, passages[0]), (None, passages[1]), (5, passages[2]), (None, None)]
    got = contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(0, None, 1.0), (1, None, 1.0), (None, None, 1.0), (2, 5, 1.0)} and len(got) == 4
