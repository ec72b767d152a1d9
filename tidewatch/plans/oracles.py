"""DuckDB twins of the registered queries. Every query text is the common preamble and one final SELECT."""

from __future__ import annotations

C, H = 24, 4  # context and horizon of the registered queries
ALPHA, SEASON = 0.3, 24
LAGS = "ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING"


def _metrics(name: str, source: str, keys: str) -> str:
    """CTEs for areas, curves and the best point of ``source`` (keys, score, y)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_g AS (SELECT {keys}, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM {source} WHERE score IS NOT NULL AND y IS NOT NULL GROUP BY {keys}, score),
{name}_c AS (SELECT {keys}, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS np, sum(neg) OVER p AS nn,
  lead(pos) OVER o AS npos, lead(neg) OVER o AS nneg, lag(pos) OVER o AS ppos
  FROM {name}_g WINDOW o AS (PARTITION BY {keys} ORDER BY score DESC), w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY {keys})),
{name}_a AS (SELECT {keys}, CASE WHEN max(np) * max(nn) > 0 THEN sum(neg * (tp - pos / 2.0)) / (max(np)::DOUBLE * max(nn)) END AS auroc,
  CASE WHEN max(np) > 0 THEN sum(pos * tp::DOUBLE / (tp + fp)) / max(np) END AS auprc FROM {name}_c GROUP BY {keys}),
{name}_r AS (SELECT {keys}, CASE WHEN nn > 0 THEN fp::DOUBLE / nn END AS fpr, CASE WHEN np > 0 THEN tp::DOUBLE / np END AS tpr, score AS threshold
  FROM {name}_c WHERE ppos IS NULL OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL SELECT {keys}, CASE WHEN max(nn) > 0 THEN 0.0 END, CASE WHEN max(np) > 0 THEN 0.0 END, 'inf'::DOUBLE FROM {name}_c GROUP BY {keys}),
{name}_j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(tpr - fpr, -2) DESC, threshold DESC) AS k FROM {name}_r) WHERE k = 1),
{name}_f AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, count(*) FILTER (y = 0 AND NOT hit) AS tn, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn, count(*) FILTER (y = 1 AND hit) AS tp
  FROM (SELECT a.*, a.score >= b.threshold AS hit FROM {source} a JOIN {name}_j b ON {on}) a GROUP BY ALL)"""


PREAMBLE = f"""WITH
ev AS (SELECT 's' || (user_id // 25) AS series_id, date_diff('hour', (SELECT date_trunc('day', min(ts)) FROM events), ts) AS t, event_type AS feature, value FROM events),
cell AS (SELECT series_id, t, feature, round(avg(value), 6) AS v FROM ev GROUP BY ALL),
len_ AS (SELECT series_id, max(t) + 1 AS n FROM ev GROUP BY 1),
spine AS (SELECT series_id, feature, n, unnest(range(n)) AS t FROM (SELECT DISTINCT series_id, feature FROM ev) JOIN len_ USING (series_id)),
raw_ AS (SELECT s.series_id, s.feature, s.t, s.n, CASE WHEN (s.t + length(s.feature)) % 17 = 0 THEN -1.0 ELSE v END AS value FROM spine s LEFT JOIN cell USING (series_id, feature, t)),
pts AS (SELECT series_id, feature, t AS place0, CASE WHEN t < floor(n * 0.2) THEN 'train' ELSE 'test' END AS split,
  CASE WHEN t < floor(n * 0.2) THEN t ELSE t - floor(n * 0.2) END::BIGINT AS t, nullif(value, -1.0) AS value FROM raw_),
lab0 AS (SELECT series_id, t, max(value) AS top FROM ev GROUP BY ALL),
lab AS (SELECT series_id, split, t, y FROM (
  SELECT h.series_id, CASE WHEN h.t < floor(n * 0.2) THEN 'train' ELSE 'test' END AS split,
    CASE WHEN h.t < floor(n * 0.2) THEN h.t ELSE h.t - floor(n * 0.2) END::BIGINT AS t, (coalesce(top, 0) > 150)::INTEGER AS y
  FROM (SELECT series_id, n, unnest(range(n)) AS t FROM len_) h LEFT JOIN lab0 USING (series_id, t))),
med AS (SELECT series_id, feature, median(value) AS med FROM pts WHERE split = 'train' GROUP BY ALL HAVING count(value) > 0),
imp AS (SELECT p.series_id, p.feature, split, place0, t, coalesce(value, med) AS value FROM pts p JOIN med USING (series_id, feature)),
fit AS (SELECT series_id, feature, avg(value) AS mu, coalesce(nullif(stddev_pop(value), 0), 1) AS sd, min(value) AS lo, max(value) AS hi FROM imp WHERE split = 'train' GROUP BY ALL),
z AS (SELECT i.series_id, i.feature, split, place0, t, (value - mu) / sd AS value FROM imp i JOIN fit USING (series_id, feature)),
win0 AS (SELECT series_id, feature, split, t, value, list(value) OVER (PARTITION BY series_id, split, feature ORDER BY t {LAGS}) AS ctx,
  list(value) OVER (PARTITION BY series_id, split, feature ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS fut5 FROM z),
win AS (SELECT series_id, feature, split, t, ctx, fut5[1:4] AS fut, len(fut5) = 5 AS inner_ FROM win0 WHERE len(ctx) = 24 AND len(fut5) >= 4),
q AS (SELECT *, list_avg(ctx) AS m, list_aggregate(ctx, 'quantile_cont', 0.1) AS q10, list_aggregate(ctx, 'quantile_cont', 0.5) AS q50, list_aggregate(ctx, 'quantile_cont', 0.9) AS q90 FROM win),
err AS (SELECT series_id, feature, split, t, list_avg(list_transform(fut, lambda y: abs(y - m) / greatest((q90 - q10) / 2.56, 0.001))) AS err FROM q WHERE inner_),
cal AS (SELECT series_id, feature, avg(err) AS mu, stddev_pop(err) + 1e-8 AS sd FROM err WHERE split = 'train' GROUP BY ALL),
sc AS (SELECT e.series_id, e.feature, e.t, (err - coalesce(mu, 0)) / coalesce(sd, 1) AS score FROM err e LEFT JOIN cal USING (series_id, feature) WHERE split = 'test'),
comb AS (SELECT series_id, t, max(score) AS "max", avg(score) AS "mean", sqrt(sum(score * score)) AS l2, avg(abs(score)) AS mae, avg(score * score) AS mse,
  list_avg(list_reverse_sort(list(score))[1:3]) AS topk, list_avg(list_reverse_sort(list(score))[1:greatest(1, max(nf) // 4)]) AS topquarter
  FROM sc JOIN (SELECT series_id, count(DISTINCT feature) AS nf FROM sc GROUP BY 1) USING (series_id) GROUP BY ALL),
mse_ AS (SELECT series_id, t, avg(e) AS score FROM (SELECT series_id, t, unnest(list_transform(fut, lambda y: (y - m) * (y - m))) AS e FROM q WHERE split = 'test') GROUP BY ALL),
msed AS (SELECT s.series_id, s.t, coalesce(score, 0) AS score FROM (SELECT DISTINCT series_id, t FROM z WHERE split = 'test') s LEFT JOIN mse_ USING (series_id, t)),
mev AS (SELECT series_id, t, round(score, 5) AS score, y FROM msed JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, t) WHERE t >= 24),
cev AS (SELECT c.*, y FROM comb c JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, t)),
cl AS (SELECT series_id, t, y, unnest(['max', 'topk', 'l2', 'mae']) AS method, unnest([round("max", 4), round(topk, 4), round(l2, 4), round(mae, 4)]) AS score FROM cev),
{_metrics("m", "mev", "series_id")},
{_metrics("k", "cl", "series_id, method")},
bw AS (SELECT series_id, feature, split, place0, t, list(value) OVER (PARTITION BY series_id, feature ORDER BY place0 {LAGS}) AS ctx FROM pts_ready),
bf AS (SELECT series_id, feature, place0, unnest(range(4)) AS j, list_aggregate(ctx, 'quantile_cont', 0.1) AS q10, list_aggregate(ctx, 'quantile_cont', 0.5) AS q50, list_aggregate(ctx, 'quantile_cont', 0.9) AS q90
  FROM bw WHERE split = 'test' AND len(ctx) >= 1 AND t % 4 = 0),
bg AS (SELECT p.series_id, p.feature, p.t, p.value AS y, q10, q50, q90 FROM bf JOIN pts_ready p ON p.series_id = bf.series_id AND p.feature = bf.feature AND p.place0 = bf.place0 + j AND p.split = 'test'),
bs AS (SELECT series_id, feature, t, greatest(y - q90, 0.0) + greatest(q10 - y, 0.0) AS score FROM bg),
bp AS (SELECT series_id, feature, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM bs GROUP BY ALL),
bn AS (SELECT b.series_id, b.feature, t, CASE WHEN hi - lo < 1e-8 THEN 0.0 ELSE (least(greatest(score, lo), hi) - lo) / (hi - lo) END AS score FROM bs b JOIN bp USING (series_id, feature)),
bc AS (SELECT series_id, t, coalesce(score, 0) AS score FROM (SELECT DISTINCT series_id, t FROM imp WHERE split = 'test') LEFT JOIN (SELECT series_id, t, sqrt(sum(score * score)) AS score FROM bn GROUP BY ALL) USING (series_id, t)),
bm AS (SELECT series_id, score, t, t2, n FROM (SELECT b.*, n, unnest([t, -1 - t, 2 * n - 1 - t]) AS t2 FROM bc b JOIN (SELECT series_id, max(t) + 1 AS n FROM bc GROUP BY 1) USING (series_id)) WHERE t2 >= -2 AND t2 < n + 2),
bsm AS (SELECT series_id, t2 AS t, s AS score FROM (SELECT *, avg(score) OVER (PARTITION BY series_id ORDER BY t2 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM bm) WHERE t2 >= 0 AND t2 < n),
bev AS (SELECT series_id, t, round(score, 5) AS score, y FROM bsm JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, t)),
{_metrics("b", "bev", "series_id")},
pair AS (SELECT series_id, split, t, max(value) FILTER (feature = 'click') AS y, max(value) FILTER (feature = 'view') AS x FROM imp GROUP BY ALL),
pw AS (SELECT *, CASE WHEN split = 'train' THEN -1 ELSE t // 24 END AS w FROM pair),
cf AS (SELECT b.series_id, b.w, regr_slope(a.y, a.x) AS sl, regr_intercept(a.y, a.x) AS ic FROM (SELECT DISTINCT series_id, w FROM pw WHERE w >= 0) b JOIN pw a ON a.series_id = b.series_id AND a.w < b.w GROUP BY ALL),
cfp AS (SELECT pw.series_id, t, y, ic + sl * x AS point FROM pw JOIN cf USING (series_id, w) WHERE split = 'test'),
ce AS (SELECT series_id, t, (y - point) * (y - point) AS s FROM cfp),
cs AS (SELECT series_id, t, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END AS score FROM ce JOIN (SELECT series_id, min(s) AS lo, max(s) AS hi FROM ce GROUP BY 1) USING (series_id)),
cvev AS (SELECT series_id, t, round(score, 5) AS score, y FROM cs JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, t)),
{_metrics("v", "cvev", "series_id")},
lc AS (SELECT l_returnflag AS series_id, date_diff('day', (SELECT date_trunc('day', min(l_shipdate)) FROM lineitem), l_shipdate) AS t, l_linestatus AS feature, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL),
ll AS (SELECT series_id, max(t) + 1 AS n FROM lc GROUP BY 1),
lsp AS (SELECT series_id, feature, n, unnest(range(n)) AS t FROM (SELECT DISTINCT series_id, feature FROM lc) JOIN ll USING (series_id)),
lp AS (SELECT s.series_id, s.feature, CASE WHEN s.t < floor(n * 0.2) THEN 'train' ELSE 'test' END AS split, CASE WHEN s.t < floor(n * 0.2) THEN s.t ELSE s.t - floor(n * 0.2) END::BIGINT AS t, v AS value FROM lsp s LEFT JOIN lc USING (series_id, feature, t))
""".replace("pts_ready", "imp")


def covariates_ctes(name: str, target: str, others: list[str], block: int = 24, source: str = "imp", ridge: float = 0.0) -> str:
    """CTEs that end in ``name`` (series_id, t, y, point): the target from all others by least squares on all earlier blocks, by elimination on the covariances, with ``ridge`` times their own added to the others' variances."""
    n = range(len(others) + 1)  # 0 is the target
    on = range(1, len(others) + 1)
    values = ", ".join(f"max(value) FILTER (feature = '{f}') AS v{i}" for i, f in enumerate([target, *others]))
    whole = " AND ".join(f"a.v{i} IS NOT NULL" for i in n)
    sums = ", ".join([*(f"avg(a.v{i}) AS m{i}" for i in n), *(f"covar_pop(a.v{i}, a.v{j}) * {1 + ridge * (i == j > 0)} AS c{i}{j}" for i in n for j in n)])
    steps = []
    for k in on[:-1]:
        later = ", ".join(f"c{i}{j} - c{i}{k} * c{k}{j} / c{k}{k} AS c{i}{j}" for i in n for j in n if (i == 0 or i > k) and (j == 0 or j > k))
        kept = ", ".join([*(f"m{i}" for i in n), *(f"p{q}{j}" for q in range(1, k) for j in n if j == 0 or j >= q), *(f"c{k}{j} AS p{k}{j}" for j in n if j == 0 or j >= k)])
        steps.append(f"{name}_{k} AS (SELECT series_id, w, {kept}, {later} FROM {name}_{k - 1})")
    last = on[-1]
    back = f"SELECT *, c{last}0 / c{last}{last} AS b{last} FROM {name}_{last - 1}"
    for k in reversed(on[:-1]):
        back = f"SELECT *, (p{k}0 - {' - '.join(f'p{k}{j} * b{j}' for j in on if j > k)}) / p{k}{k} AS b{k} FROM ({back})"
    point = "m0 + " + " + ".join(f"b{k} * (v{k} - m{k})" for k in on)
    return f"""{name}_v AS (SELECT series_id, split, t, CASE WHEN split = 'train' THEN -1 ELSE t // {block} END AS w, {values} FROM {source} GROUP BY ALL),
{name}_0 AS (SELECT b.series_id, b.w, {sums} FROM (SELECT DISTINCT series_id, w FROM {name}_v WHERE w >= 0) b JOIN {name}_v a ON a.series_id = b.series_id AND a.w < b.w WHERE {whole} GROUP BY ALL),
{", ".join(steps)},
{name} AS (SELECT series_id, t, v0 AS y, {point} AS point FROM {name}_v JOIN ({back}) USING (series_id, w) WHERE split = 'test')"""


def sweep_part(context: int, horizon: int) -> str:
    """One configuration of the sweep, as a SELECT over the preamble."""
    return f"""SELECT series_id, {context} AS context, {horizon} AS horizon, auroc, auprc FROM (
WITH w AS (SELECT series_id, feature, t, list(value) OVER (PARTITION BY series_id, feature ORDER BY t ROWS BETWEEN {context} PRECEDING AND 1 PRECEDING) AS ctx,
  list(value) OVER (PARTITION BY series_id, feature ORDER BY t ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING) AS fut FROM z WHERE split = 'test'),
e AS (SELECT series_id, t, avg(e) AS score FROM (SELECT series_id, t, unnest(list_transform(fut, lambda y: pow(y - list_avg(ctx), 2))) AS e FROM w WHERE len(ctx) = {context} AND len(fut) = {horizon}) GROUP BY ALL),
d AS (SELECT s.series_id, s.t, round(coalesce(score, 0), 5) AS score, y FROM (SELECT DISTINCT series_id, t FROM z WHERE split = 'test') s LEFT JOIN e USING (series_id, t) JOIN (SELECT * FROM lab WHERE split = 'test') USING (series_id, t) WHERE s.t >= {context}),
{_metrics("s", "d", "series_id")}
SELECT * FROM s_a)"""
