"""DuckDB twins of queries whose hash DuckDB lacks, or whose SQL takes more than a statement."""

from __future__ import annotations


#: The bytes of ``g``, from its hex digits ``x``.
BYTES = """SELECT g, length(x) // 2 AS n, list_transform(regexp_extract_all(x, '..'),
    lambda y: CAST(16 * instr('123456789ABCDEF', y[1]) + instr('123456789ABCDEF', y[2]) AS UHUGEINT)) AS bs FROM hexed"""


def hash_sql() -> str:
    """XXH64 of the column ``g`` (seed 42) in steps of plain arithmetic modulo 2^64."""
    p1, p2, p3, p4, p5, m = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261, 1 << 64
    big = lambda x: f"{x}::UHUGEINT"
    mul = lambda x, p: f"(({x}) * {big(p)} % {big(m)})"
    rotl = lambda x, r: f"(({x}) * {big(1 << r)} % {big(m)} + ({x}) // {big(1 << 64 - r)})"
    add = lambda x, y: f"((({x}) + ({y})) % {big(m)})"
    lane = lambda at, n: "(" + " + ".join(f"bs[{at} + {j + 1}] * {big(256**j)}" for j in range(n)) + ")"
    turn = lambda k: mul(rotl(mul(k, p2), 31), p1)
    fold = lambda start, items, step: f"list_reduce(list_prepend({start}, {items}), lambda h, k: {step})"
    starts = [(42 + p1 + p2) % m, (42 + p2) % m, 42, (42 - p1) % m]
    lanes = ", ".join(
        fold(big(s), f"list_transform(range(n // 32), lambda q: {lane(f'32 * q + {8 * i}', 8)})", mul(rotl(add("h", mul("k", p2)), 31), p1)) + f" AS v{i}" for i, s in enumerate(starts)
    )
    steps = [
        ("h0", add(add(rotl("v0", 1), rotl("v1", 7)), add(rotl("v2", 12), rotl("v3", 18)))),
        *((f"h{i + 1}", add(mul(f"xor(h{i}, {turn(f'v{i}')})", p1), big(p4))) for i in range(4)),
        ("e0", add(f"CASE WHEN n < 32 THEN {big((42 + p5) % m)} ELSE h4 END", "n::UHUGEINT")),
        ("e1", fold("e0", f"list_transform(range(n % 32 // 8), lambda q: {lane('n // 32 * 32 + 8 * q', 8)})", add(mul(rotl(f"xor(h, {turn('k')})", 27), p1), big(p4)))),
        ("x4", f"CASE WHEN n % 8 >= 4 THEN {lane('n // 8 * 8', 4)} END"),
        ("e2", f"CASE WHEN x4 IS NULL THEN e1 ELSE {add(mul(rotl(f'xor(e1, {mul("x4", p1)})', 23), p2), big(p3))} END"),
        ("e3", fold("e2", "list_slice(bs, n - n % 4 + 1, n)", mul(rotl(f"xor(h, {mul('k', p5)})", 11), p1))),
        ("e4", mul(f"xor(e3, e3 // {big(1 << 33)})", p2)),
        ("e5", mul(f"xor(e4, e4 // {big(1 << 29)})", p3)),
        ("e6", f"xor(e5, e5 // {big(1 << 32)})"),
    ]
    out = f"SELECT g, bs, n, {lanes} FROM bytes"
    for name, value in steps:
        out = f"SELECT *, {value} AS {name} FROM ({out})"
    return f"SELECT g, CAST(e6 AS UBIGINT) AS h FROM ({out})"


#: A shingle's hash is computed once; fingerprints link at 3 or fewer differing bits.
OP3_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT r, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)
), hexed AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM s)
), bytes AS (
  {BYTES}
), hashed AS MATERIALIZED (
  {hash_sql()}
), bits AS (
  SELECT r, b, 2 * sum(CAST((h >> b) & 1 AS BIGINT)) > count(*) AS up FROM (SELECT r, h, unnest(range(64))::UBIGINT AS b FROM s JOIN hashed USING (g)) GROUP BY r, b
), f AS MATERIALIZED (
  SELECT doc_id, coalesce(p, 0::UBIGINT) AS p FROM d LEFT JOIN (SELECT r, bit_or(1::UBIGINT << b) AS p FROM bits WHERE up GROUP BY r) USING (r)
), u AS MATERIALIZED (
  SELECT p, min(doc_id) AS least FROM f GROUP BY p
), links AS MATERIALIZED (
  SELECT a.p AS a, b.p AS b FROM u AS a JOIN u AS b ON bit_count(xor(a.p, b.p)) <= 3
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), c AS (
  SELECT a AS p, min(least) AS component_id FROM reach JOIN u ON u.p = reach.b GROUP BY a
)
SELECT doc_id, lpad(lower(to_hex(p)), 16, '0') AS fingerprint, component_id FROM f JOIN c USING (p)
"""


def row_hash_sql(seed: int = 42) -> str:
    """Spark's ``xxhash64(seed, id, tie)`` of the columns ``id`` (may be null) and ``tie`` (both UHUGEINT, modulo 2^64), in steps."""
    p1, p2, p3, p4, p5, m = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261, 1 << 64
    h = (42 + p5 + 4) % m ^ seed * p1 % m
    h = ((h << 23 | h >> 41) % m * p2 + p3) % m
    for shift, p in ((33, p2), (29, p3), (32, 1)):
        h = (h ^ h >> shift) * p % m
    big = lambda x: f"{x}::UHUGEINT"
    mul = lambda x, p: f"(({x}) * {big(p)} % {big(m)})"
    rotl = lambda x, r: f"(({x}) * {big(1 << r)} % {big(m)} + ({x}) // {big(1 << 64 - r)})"
    out, last = "keyed", big(h)
    for c in ("id", "tie"):
        first = f"xor(({last} + {big((p5 + 8) % m)}) % {big(m)}, {mul(rotl(mul(c, p2), 31), p1)})"
        steps = [first, f"({mul(rotl(f'{c}0', 27), p1)} + {big(p4)}) % {big(m)}"]
        steps += [mul(f"xor({c}{k}, {c}{k} // {big(1 << s)})", p) for k, s, p in ((1, 33, p2), (2, 29, p3))]
        steps += [f"coalesce(xor({c}3, {c}3 // {big(1 << 32)}), {last})"]
        for k, step in enumerate(steps):
            out = f"(SELECT *, {step} AS {c}{k} FROM {out})"
        last = f"{c}4"
    return f"SELECT *, {last} AS hash FROM {out}"


#: The mix in order of the same keys, without slices.
OP4_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS g,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), hexed AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM d)
), bytes AS (
  {BYTES}
), hashed AS MATERIALIZED (
  {hash_sql()}
), keyed AS (
  SELECT r, h, CAST(CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id END AS UHUGEINT) AS id, h::UHUGEINT AS tie
  FROM d JOIN hashed USING (g)
), drawn AS MATERIALIZED (
  {row_hash_sql()}
), q AS (
  SELECT doc_id, avg(quality) * 1.5 + 0.5 AS weight FROM labels GROUP BY doc_id
), k AS MATERIALIZED (
  SELECT r, d.doc_id, source, size, CASE WHEN h >= 9223372036854775808 THEN CAST(h::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(h AS BIGINT) END AS tie,
    -ln((CAST(hash // 4096::UHUGEINT AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE) / CASE WHEN weight > 0 THEN weight ELSE 1.0::DOUBLE END AS draw
  FROM d JOIN drawn USING (r) LEFT JOIN q ON q.doc_id = d.doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM k GROUP BY source
), l AS (
  SELECT *, greatest(sum(source_size::DOUBLE) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER before, 0), 0) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN level * w >= source_size * 3 THEN source_size * 3.0::DOUBLE
    ELSE max(CASE WHEN level * w < source_size * 3 THEN level END) OVER () * w END AS target FROM l
), o AS (
  SELECT k.*, source_size, target, CAST(round(target) AS BIGINT) AS quota, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY draw, k.doc_id NULLS FIRST, size, tie ROWS UNBOUNDED PRECEDING) - size AS earlier
  FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, quota - epochs * source_size - earlier)) AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs
FROM o
"""


#: CRC-32 of the sixteen half bytes.
CRC_TABLE = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]


def loops_sql(scales: int = 16) -> str:
    """Periodic runs by self joins: a gram of the next scale is two of this one, and only places whose gram repeats go on."""
    halves = "flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: [CAST(ascii(c) AS BIGINT) & 15, CAST(ascii(c) AS BIGINT) >> 4]))"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, v: xor(c >> 4, ({CRC_TABLE}::BIGINT[])[(xor(c, v) & 15) + 1])))"
    near = "lead(i) OVER (PARTITION BY r, g ORDER BY i) - i AS lag, lag(i) OVER (PARTITION BY r, g ORDER BY i) AS prior"
    steps = [f"p0 AS MATERIALIZED (SELECT *, {near} FROM (SELECT r, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 4)) AS i FROM l)))"]
    steps.append(f"p1 AS MATERIALIZED (SELECT *, {near} FROM (SELECT r, i, array_to_string(ws[i + 1:i + 6], ' ') AS g FROM p0 JOIN l USING (r) WHERE i + 6 <= len(ws) AND (lag IS NOT NULL OR prior IS NOT NULL)))")
    for j in range(2, scales):
        k, rep = 3 << (j - 1), f"(SELECT r, i, g FROM p{j - 1} WHERE lag IS NOT NULL OR prior IS NOT NULL)"
        steps.append(f"p{j} AS MATERIALIZED (SELECT *, {near} FROM (SELECT a.r, a.i, md5(a.g || ' ' || b.g) AS g FROM {rep} a JOIN {rep} b ON b.r = a.r AND b.i = a.i + {k}))")
    size = lambda j: 5 if j == 0 else 3 << j
    seeds = " UNION ALL ".join(f"SELECT r, i, lag, {size(j)} AS k FROM p{j} WHERE lag >= {1 << j} AND lag < {2 << j}" for j in range(scales))
    steps_sql = ",\n".join(steps)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {crc} AS h FROM documents
), v AS (
  SELECT *, len(ws) AS n, (h // 10) AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w
), l AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws
  FROM v
), {steps_sql}, s AS (
  {seeds}
), f AS (
  SELECT r, lag AS period, min(i) AS start, max(i) + any_value(k) + lag - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM s) GROUP BY r, lag, island
), t AS MATERIALIZED (
  SELECT * FROM f WHERE length >= greatest(6, 4 * period)
), b AS (
  SELECT r, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM t GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM t
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS words
  FROM (SELECT r, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM l) ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM l LEFT JOIN b USING (r) LEFT JOIN kept USING (r)
"""


OP11_SQL = loops_sql()
