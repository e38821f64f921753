"""SQL twins of the registered queries, for the engine that checks them on the same tables."""
from __future__ import annotations

import numpy as np

from kinetide.operators import forests, recurrence
from kinetide.functions.dsp import EDGE, MUSCLE_LOW
from kinetide.plans import tables as T

H, D = T.HOUR, T.DAY
STATS = ["mean", "std", "min", "max", "rms", "zcr"]

EV = """ev AS (SELECT user_id AS session_id, epoch_us(ts) AS t, event_id, event_type, value,
  value - CAST(50 AS DOUBLE) AS x, props, strftime(ts, '%Y-%m-%d') AS day_str FROM events)"""
MK = "mk AS (SELECT event_id AS marker_id, session_id, t FROM ev WHERE event_type = 'error')"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def looks(length: int, shifts: int = 1, name: str = "pos") -> str:
    step = length // 3
    return f"""{name} AS (SELECT 'p:' || marker_id || ':' || k AS window_id, session_id,
  CAST(t - {T.BUFFER} - k * {step} - {length} AS BIGINT) AS start_t, CAST(t - {T.BUFFER} - k * {step} AS BIGINT) AS end_t,
  CAST(1 AS INTEGER) AS label, CAST(k AS INTEGER) AS horizon FROM mk, range({shifts}) AS s(k))"""


def joined(windows: str, name: str = "sl", extra: str = "") -> str:
    """Samples inside windows with their previous sample's sign and position inside the window."""
    return f"""{name} AS (SELECT w.*, e.t, e.x,
  lag(sign(e.x)) OVER (PARTITION BY w.window_id{extra} ORDER BY e.t) AS before
  FROM {windows} w JOIN ev e ON e.session_id = w.session_id AND e.t >= w.start_t AND e.t < w.end_t)"""


STAT_SQL = {
    "mean": "avg(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "rms": "sqrt(avg(x * x))",
    "zcr": "CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE before <> sign(x)) / CAST(count(*) - 1 AS DOUBLE) ELSE 0.0 END",
}


def stats(prefix: str = "x_", digits: int = 6) -> str:
    return ", ".join(r(STAT_SQL[s], prefix + s, digits) for s in STATS)


def raw_stats(prefix: str = "x_") -> str:
    return ", ".join(f"{STAT_SQL[s]} AS {prefix}{s}" for s in STATS)


def labelled(length: int, all_negatives: bool = False) -> str:
    """CTEs up to `win`: non-empty positives and (matched) negatives."""
    limit = "" if all_negatives else "AND rn <= n_pos"
    return f"""{EV}, {MK}, {looks(length)},
ne AS (SELECT * FROM pos p WHERE EXISTS (SELECT 1 FROM ev e WHERE e.session_id = p.session_id AND e.t >= p.start_t AND e.t < p.end_t)),
bounds AS (SELECT session_id, min(t) AS t_min, max(t) AS t_max FROM ev GROUP BY 1),
tiles AS (SELECT session_id, CAST(t_min + k * {length} AS BIGINT) AS start_t, CAST(t_min + (k + 1) * {length} AS BIGINT) AS end_t
  FROM (SELECT *, unnest(range(0, CAST(floor((t_max - t_min - {length}) / CAST({length} AS DOUBLE)) AS BIGINT) + 1)) AS k FROM bounds WHERE t_max - t_min >= {length})),
cand AS (SELECT * FROM tiles c WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.session_id = c.session_id AND c.end_t > p.start_t AND c.start_t < p.end_t)),
wanted AS (SELECT session_id, count(*) AS n_pos FROM ne GROUP BY 1),
ranked AS (SELECT c.*, n_pos, row_number() OVER (PARTITION BY c.session_id ORDER BY md5('42:' || c.session_id || ':' || c.start_t)) AS rn
  FROM cand c {"LEFT" if all_negatives else ""} JOIN wanted USING (session_id)),
neg AS (SELECT 'n:' || session_id || ':' || start_t AS window_id, session_id, start_t, end_t, CAST(0 AS INTEGER) AS label,
  CAST(0 AS INTEGER) AS horizon FROM ranked r WHERE EXISTS (SELECT 1 FROM ev e WHERE e.session_id = r.session_id AND e.t >= r.start_t AND e.t < r.end_t) {limit}),
win AS (SELECT * FROM ne UNION ALL SELECT * FROM neg)"""


def feature_table(name: str = "ft") -> str:
    """CTEs up to `ft`: labelled feature table with its day (unrounded)."""
    return f"""{labelled(T.SHORT)}, {joined('win')},
{name} AS (SELECT window_id, session_id, end_t, label, count(*) AS n_samples, {raw_stats()},
  strftime(DATE '1970-01-01' + CAST(floor(end_t / CAST({D} AS DOUBLE)) AS INTEGER), '%Y-%m-%d') AS day_str
  FROM sl GROUP BY 1, 2, 3, 4 HAVING count(*) >= {T.SHORT_LEAST})"""


def auc(source: str, keys: str, name: str = "aucs") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    select, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""rk AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part + ',' if part else 'PARTITION BY'} score) - 1) / 2.0 AS rnk FROM {source}),
{name} AS (SELECT {select}sum(label) AS n_pos, sum(1 - label) AS n_neg,
  CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(CASE WHEN label = 1 THEN CAST(rnk AS DOUBLE) END) - sum(label) * (sum(label) + 1) / 2.0)
  / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) END AS auc FROM rk {group})"""


SCORED = f"""{EV}, sc AS (SELECT day_str, value AS score, CAST(event_type = 'error' AS INTEGER) AS label, CAST(value > 50 AS INTEGER) AS predicted FROM ev)"""
CONF = """count(*) FILTER (WHERE predicted = 1 AND label = 1) AS tp, count(*) FILTER (WHERE predicted = 1 AND label = 0) AS fp,
  count(*) FILTER (WHERE predicted = 0 AND label = 1) AS fn, count(*) FILTER (WHERE predicted = 0 AND label = 0) AS tn"""
F1 = "CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp / CAST(2*tp+fp+fn AS DOUBLE) ELSE 0.0 END"
PRECISION = "CASE WHEN tp+fp > 0 THEN tp / CAST(tp+fp AS DOUBLE) ELSE 0.0 END"
RECALL = "CASE WHEN tp+fn > 0 THEN tp / CAST(tp+fn AS DOUBLE) ELSE 0.0 END"
FOLDS = f"""{SCORED}, {auc('sc', 'day_str')}, cf AS (SELECT day_str, {CONF} FROM sc GROUP BY 1),
folds AS (SELECT day_str, auc, {F1} AS f1 FROM aucs JOIN cf USING (day_str) WHERE auc IS NOT NULL)"""

SHIP = """sh AS (SELECT session_id, ((ord * 4096 + t) * 8 + ascii(l_returnflag) % 4 * 2 + ascii(l_linestatus) % 2) AS file_offset, t, l_returnflag, l_linestatus
  FROM (SELECT l_suppkey AS session_id, l_orderkey * 8 + l_linenumber AS ord,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, l_returnflag, l_linestatus FROM lineitem))"""
JUMPS = f"""{SHIP}, lg AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY file_offset) AS prev_t FROM sh)"""

RUNS = f"""{EV}, med AS (SELECT session_id, median(value) AS m FROM ev GROUP BY 1),
fl AS (SELECT ev.session_id, t, value, value > 1.0 * m AS above FROM ev JOIN med USING (session_id)),
op AS (SELECT *, CASE WHEN above AND NOT coalesce(lag(above) OVER (PARTITION BY session_id ORDER BY t), false) THEN 1 ELSE 0 END AS o FROM fl),
nb AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY t) AS run FROM op),
runs AS (SELECT session_id, min(t) AS start_t, max(t) AS end_t, max(value) AS peak FROM nb WHERE above GROUP BY session_id, run)"""

BEATS = f"""{EV}, {MK}, {looks(T.BEAT_SPAN)},
bt AS (SELECT p.window_id, e.t * CAST({T.BEAT_UNIT} AS DOUBLE) AS t FROM pos p JOIN ev e ON e.session_id = p.session_id AND e.t >= p.start_t AND e.t < p.end_t),
lagged AS (SELECT *, t - lag(t) OVER (PARTITION BY window_id ORDER BY t) AS ibi FROM bt),
ib AS (SELECT * FROM lagged WHERE ibi > 0)"""


def rejected(fraction: float) -> str:
    return f"""{BEATS},
ar AS (SELECT *, list_concat(coalesce(list(ibi) OVER (PARTITION BY window_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []),
  coalesce(list(ibi) OVER (PARTITION BY window_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), [])) AS around FROM ib),
md AS (SELECT window_id, t, ibi, list_median(around) AS local_median FROM (SELECT *, 1 FROM ar)),
ck AS (SELECT *, NOT coalesce(local_median > 0 AND abs(ibi - local_median) / local_median > {fraction}, false) AS valid FROM md)""".replace(
        "list_median(around)", "list_aggregate(around, 'median')")


def heart(fraction: float) -> str:
    return f"""{rejected(fraction)},
hr AS (SELECT *, lag(ibi) OVER w AS ib0, lag(valid) OVER w AS v0, min(t) OVER (PARTITION BY window_id) AS t0 FROM ck WINDOW w AS (PARTITION BY window_id ORDER BY t)),
hs AS (SELECT window_id, count(*) AS n_ibis, avg(60000.0 / ibi) AS raw, count(*) FILTER (WHERE valid) AS n_valid,
  avg(60000.0 / ibi) FILTER (WHERE valid) AS tm, regr_slope(60000.0 / ibi, (t - t0) / 1000.0) FILTER (WHERE valid) AS slope,
  count(*) FILTER (WHERE valid AND v0) AS n_steps, sqrt(avg((ibi - ib0) * (ibi - ib0)) FILTER (WHERE valid AND v0)) AS rm,
  stddev_pop(ibi) FILTER (WHERE valid) AS sd FROM hr GROUP BY 1),
hf AS (SELECT window_id, n_ibis, CASE WHEN n_ibis >= 2 THEN raw END AS raw_hr_mean, n_ibis >= 2 AND raw BETWEEN 40 AND 180 AS plausible_hr,
  CASE WHEN n_ibis >= 2 AND raw BETWEEN 40 AND 180 THEN n_valid ELSE 0 END AS n_valid,
  CASE WHEN n_ibis >= 2 AND raw BETWEEN 40 AND 180 AND n_valid >= 5 THEN tm END AS hr_trend_mean,
  CASE WHEN n_ibis >= 2 AND raw BETWEEN 40 AND 180 AND n_valid >= 5 THEN slope * 60 END AS hr_trend_slope,
  CASE WHEN n_ibis >= 2 AND raw BETWEEN 40 AND 180 AND n_valid >= 10 AND n_steps >= 9 THEN rm END AS rmssd_clean,
  CASE WHEN n_ibis >= 2 AND raw BETWEEN 40 AND 180 AND n_valid >= 10 THEN sd END AS sdnn_clean FROM hs)"""


def draws(days: str, reps: int = 200) -> str:
    return f"""dl AS (SELECT DISTINCT day FROM {days}), dn AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n_days FROM dl),
dr AS (SELECT CAST(rep AS INTEGER) AS rep, CAST(slot AS INTEGER) AS slot,
  CAST('0x' || substr(md5('42:' || rep || ':' || slot), 1, 8) AS BIGINT) % n AS pos
  FROM range({reps}) AS a(rep), (SELECT count(*) AS n FROM dl), range(CAST(n AS BIGINT)) AS b(slot)),
drawn AS (SELECT rep, slot, day FROM dr JOIN dn USING (pos))"""


def value_reps(kind: str, suffix: str) -> str:
    s = f"""s{suffix} AS (SELECT day_str, value AS score, CAST(event_type = '{kind}' AS INTEGER) AS label FROM ev), """
    return s + auc(f"s{suffix}", "day_str", f"aucs{suffix}").replace("rk AS", f"rk{suffix} AS").replace("FROM rk ", f"FROM rk{suffix} ") + f""",
rep{suffix} AS (SELECT rep, avg(auc) AS v FROM (SELECT DISTINCT rep, day FROM drawn) JOIN aucs{suffix} ON day = day_str GROUP BY rep)"""


def naive_bayes() -> str:
    return """em AS (SELECT vec_id, 'd' || (vec_id % 5) AS fold, CAST(label >= 5 AS INTEGER) AS label,
  unnest(range(1, 65)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
fo AS (SELECT DISTINCT fold AS f FROM em),
tr AS (SELECT f, label, j, avg(v) AS mu, var_pop(v) AS va, count(*) AS n FROM em JOIN fo ON fold <> f GROUP BY 1, 2, 3),
sc0 AS (SELECT f, j, var_pop(v) AS s2 FROM em JOIN fo ON fold <> f GROUP BY 1, 2),
fl AS (SELECT tr.*, va + 1e-9 * s2 AS vv FROM tr JOIN sc0 USING (f, j)),
pr AS (SELECT f, max(n) FILTER (WHERE label = 1) AS n1, max(n) FILTER (WHERE label = 0) AS n0 FROM tr GROUP BY 1),
ll AS (SELECT em.vec_id, em.fold, em.label AS y, fl.label AS c, sum(-0.5 * ln(vv) - (v - mu) * (v - mu) / (2 * vv)) AS l
  FROM em JOIN fl ON fl.f = em.fold AND fl.j = em.j GROUP BY 1, 2, 3, 4),
lo AS (SELECT vec_id, fold, y, sum(CASE WHEN c = 1 THEN l ELSE -l END) + ln(max(n1)) - ln(max(n0)) AS z FROM ll JOIN pr ON f = fold GROUP BY 1, 2, 3),
sc AS (SELECT fold AS model_id, y AS label, 1 / (1 + exp(-z)) AS score, CAST(z > 0 AS INTEGER) AS predicted FROM lo)"""


def muscle_filter(coefficients: tuple = MUSCLE_LOW) -> str:
    """Forward and backward recursion of a low-pass over the oddly extended series, sample by sample."""
    b, a = (np.array(c) for c in coefficients)
    n, edge = len(a) - 1, 3 * len(a)
    step = np.zeros((n, n))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(n - 1)
    z = np.linalg.solve(np.eye(n) - step, b[1:] - a[1:] * b[0])  # state after a long constant input of 1

    def one(name: str, source: str) -> str:
        def advance(x: str, old: list[str]) -> str:
            y = f"({b[0]!r} * {x} + {old[0]})".replace("np.float64", "")
            new = [f"{b[k]!r} * {x} - {a[k]!r} * {y}".replace("np.float64", "") + (f" + {old[k]}" if k < n else "") for k in range(1, n + 1)]
            return f"{y} AS y, " + ", ".join(f"{e} AS z{k}" for k, e in enumerate(new))
        first = [f"{v!r} * x".replace("np.float64", "") for v in z]
        return f"""{name} AS (SELECT session_id, i, {advance('x', first)} FROM {source} WHERE i = 0 UNION ALL
  SELECT s.session_id, s.i, {advance('s.x', [f'z{k}' for k in range(n)])} FROM {name} f JOIN {source} s ON s.session_id = f.session_id AND s.i = f.i + 1)"""

    return f"""{EV}, sq AS (SELECT session_id, t, abs(trunc(value)) AS v, row_number() OVER (PARTITION BY session_id ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY session_id) AS n FROM ev),
ls AS (SELECT session_id, n, list(v ORDER BY j) AS l FROM sq WHERE n > {edge} GROUP BY 1, 2),
ext AS MATERIALIZED (SELECT session_id, n, i, CASE WHEN i < {edge} THEN 2 * l[1] - l[{edge} - i + 1] WHEN i < n + {edge} THEN l[i - {edge} + 1] ELSE 2 * l[n] - l[2 * n - 1 - (i - {edge})] END AS x
  FROM (SELECT *, unnest(range(n + {2 * edge})) AS i FROM ls)),
{one('fw', 'ext')}, rev AS MATERIALIZED (SELECT fw.session_id, n + {2 * edge} - 1 - fw.i AS i, y AS x FROM fw JOIN ls USING (session_id)),
{one('bw', 'rev')}, env AS (SELECT sq.session_id, t, v, y AS envelope FROM bw JOIN sq ON sq.session_id = bw.session_id AND sq.j = n + {edge} - 1 - bw.i)"""


def logistic_fit(C: float, l2: float, l1: float = 0.0, prior: float = 0.0, balanced: bool = True, everything: bool = False, steps: int = 14) -> str:
    """Leave-one-day-out Newton steps for one feature, the 2 x 2 system and the absolute penalty solved in closed form."""
    weight = "CASE WHEN label = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END" if balanced else "1.0"
    other = "f = 'all'" if everything else "day_str <> f"
    folds = "SELECT 'all' AS f" if everything else "SELECT day_str AS f FROM ft GROUP BY 1 HAVING min(label) < max(label)"
    return f"""{feature_table()}, fo AS ({folds}),
st AS (SELECT f, avg(x_mean) AS mu, stddev_pop(x_mean) AS sd, count(*) AS n, sum(label) AS n1 FROM ft JOIN fo ON {other} GROUP BY 1),
tr AS MATERIALIZED (SELECT f, (x_mean - mu) / sd AS v, CAST(label AS DOUBLE) AS y, CAST({weight} AS DOUBLE) AS w FROM ft JOIN st ON {other}),
it AS (SELECT f, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST({prior} AS DOUBLE) * sd AS b, CAST({prior} AS DOUBLE) * sd AS p, CAST(0 AS DOUBLE) AS curve FROM st
UNION ALL SELECT f, k + 1, a - (g0 + h01 * (nb - b)) / h00, nb, p, h11 - h01 * h01 / h00 FROM (
  SELECT *, sign(target) * greatest(abs(target) - {l1} / (h11 - h01 * h01 / h00), 0) AS nb FROM (
  SELECT *, b - (g1 - h01 / h00 * g0) / (h11 - h01 * h01 / h00) AS target FROM (
  SELECT f, k, a, b, p, {C} * sum(w * (q - y)) AS g0, {C} * sum(w * (q - y) * v) + {l2} * (b - p) AS g1,
    {C} * sum(w * q * (1 - q)) AS h00, {C} * sum(w * q * (1 - q) * v) AS h01, {C} * sum(w * q * (1 - q) * v * v) + {l2} AS h11
  FROM (SELECT it.*, v, y, w, 1 / (1 + exp(-(a + b * v))) AS q FROM it JOIN tr USING (f) WHERE k < {steps}) GROUP BY f, k, a, b, p)))),
fin AS (SELECT * FROM it WHERE k = {steps})"""


def conditional_fit(steps: int = 14) -> str:
    return f"""{feature_table()}, fo AS (SELECT day_str AS f FROM ft GROUP BY 1 HAVING min(label) < max(label)),
st AS (SELECT f, avg(x_mean) AS mu, stddev_pop(x_mean) AS sd FROM ft JOIN fo ON day_str <> f GROUP BY 1),
pr AS (SELECT a.day_str, a.x_mean - b.x_mean AS d, row_number() OVER (PARTITION BY a.window_id ORDER BY abs(a.end_t - b.end_t), b.end_t, b.window_id) AS rn
  FROM ft a JOIN ft b ON a.day_str = b.day_str AND a.label = 1 AND b.label = 0),
tr AS MATERIALIZED (SELECT f, d / sd AS d FROM pr JOIN st ON day_str <> f WHERE rn = 1),
it AS (SELECT f, 0 AS k, CAST(0 AS DOUBLE) AS b FROM st UNION ALL
  SELECT f, k + 1, b - (b - 2 * sum(d * s)) / (1 + 2 * sum(d * d * s * (1 - s))) FROM (SELECT it.*, d, 1 / (1 + exp(b * d)) AS s FROM it JOIN tr USING (f) WHERE k < {steps}) GROUP BY f, k, b),
fin AS (SELECT f, CAST(0 AS DOUBLE) AS a, b FROM it WHERE k = {steps})"""


def fit_scores(closed: str) -> str:
    return f"""sc AS (SELECT f AS model_id, label, score, CAST(score {closed} 0.5 AS INTEGER) AS predicted FROM
  (SELECT f, label, 1 / (1 + exp(-(a + b * (x_mean - mu) / sd))) AS score FROM ft JOIN st ON day_str = f JOIN fin USING (f))),
{auc('sc', 'model_id')}, cf AS (SELECT model_id, {CONF}, avg(score) AS ms FROM sc GROUP BY 1)
SELECT model_id, {r('auc', 'auc')}, {r(F1, 'f1')}, {r('ms', 'mean_score')} FROM aucs JOIN cf USING (model_id) WHERE auc IS NOT NULL"""


def window_bayes() -> str:
    melt = " UNION ALL ".join(f"SELECT window_id, day_str AS fold, label, 'x_{s}' AS j, x_{s} AS v FROM ft" for s in STATS)
    return f"""em AS ({melt}),
fo AS""" + naive_bayes().split(",\nfo AS")[1].replace("vec_id", "window_id")


def bayes_bootstrap() -> str:
    """Training rows of a resample are the day's rows times its multiplicity, so moments are weighted sums."""
    return f"""WITH dd AS (SELECT 'd' || (vec_id % 5) AS day FROM embeddings), {draws('dd', 50)},
ct AS (SELECT rep, day, count(*) AS mult FROM drawn GROUP BY 1, 2),
pl AS (SELECT a.rep, a.day AS test, b.day AS train, b.mult FROM ct a JOIN ct b ON a.rep = b.rep AND a.day <> b.day),
em AS (SELECT vec_id, 'd' || (vec_id % 5) AS day, CAST(label >= 5 AS INTEGER) AS label, unnest(range(1, 65)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
dm AS (SELECT day, label, j, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM em GROUP BY 1, 2, 3),
tr AS (SELECT rep, test, label, j, sum(mult * n) AS n, sum(mult * s) AS s, sum(mult * q) AS q FROM pl JOIN dm ON dm.day = pl.train GROUP BY 1, 2, 3, 4),
al AS (SELECT rep, test, j, sum(q) / sum(n) - power(sum(s) / sum(n), 2) AS s2 FROM tr GROUP BY 1, 2, 3),
mo AS (SELECT tr.rep, tr.test, label, tr.j, n, s / n AS mu, q / n - power(s / n, 2) + 1e-9 * s2 AS vv FROM tr JOIN al USING (rep, test, j)),
pr AS (SELECT rep, test, max(n) FILTER (WHERE label = 1) AS n1, max(n) FILTER (WHERE label = 0) AS n0 FROM mo GROUP BY 1, 2),
ll AS (SELECT mo.rep, mo.test, em.vec_id, em.label AS y, sum((CASE WHEN mo.label = 1 THEN 1 ELSE -1 END) * (-0.5 * ln(vv) - (v - mu) * (v - mu) / (2 * vv))) AS l
  FROM em JOIN mo ON mo.test = em.day AND mo.j = em.j GROUP BY 1, 2, 3, 4),
sc AS (SELECT rep || '|' || test AS model_id, rep, y AS label, l + ln(n1) - ln(n0) AS score FROM ll JOIN pr USING (rep, test)), {auc('sc', 'rep, model_id')}
SELECT rep, {r('avg(auc)', 'mean_auc')} FROM aucs WHERE auc IS NOT NULL GROUP BY 1"""


def forest_scores(trees: int = 200, depth: int = 3, leaf: int = 8, seed: int = 42) -> str:
    """CTEs up to sc(model_id, label, score, predicted): a forest for each day left out, level by level, over the embeddings."""
    P, d, k = forests.PRIME, 64, 8
    half = lambda text, at: f"CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT)"
    bag = " + ".join(f"CAST(u >= {x} AS BIGINT)" for x in forests.POISSON)
    probs = ", ".join(f"{i}.0 / {forests.BINS}" for i in range(1, forests.BINS))
    parts = [f"""
em AS (SELECT vec_id, 'd' || (vec_id % 5) AS day, CAST(label >= 5 AS INTEGER) AS y, unnest(range({d})) AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
ct AS (SELECT DISTINCT f, unnest(quantile_cont(v, [{probs}])) AS c FROM em GROUP BY f),
bn AS MATERIALIZED (SELECT vec_id, em.f, count(*) FILTER (WHERE c < v) AS bin FROM em JOIN ct ON em.f = ct.f GROUP BY 1, 2),
tr AS (SELECT CAST(range AS BIGINT) AS t, {half(f"'{seed}:' || range", 1)} % {P - 1} + 1 AS ta, {half(f"'{seed}:' || range", 9)} % {P} AS tb FROM range({trees})),
rw AS (SELECT vec_id, 'd' || (vec_id % 5) AS day, CAST(label >= 5 AS INTEGER) AS y, {half('CAST(vec_id AS VARCHAR)', 1)} AS h FROM embeddings),
bg AS (SELECT vec_id, day, y, t, {bag} AS m FROM (SELECT *, (h * ta + tb) % {P} AS u FROM rw, tr)),
fo AS (SELECT DISTINCT day AS fold FROM rw),
cw AS (SELECT fold, y, CAST(round(sum(count(*)) OVER (PARTITION BY fold) / (2.0::DOUBLE * count(*)) * {forests.CLASS_UNIT}) AS BIGINT) AS w FROM rw JOIN fo ON day <> fold GROUP BY fold, y),
ch AS MATERIALIZED (SELECT t, path, f FROM (SELECT *, row_number() OVER (PARTITION BY t, path ORDER BY (x * x) % {P}, f) AS rn FROM
  (SELECT t, path, f, ((path * 7919 + f + 1) * ta + tb) % {P} AS x FROM tr, (SELECT CAST(range AS BIGINT) AS path FROM range(1, {2 ** depth})), (SELECT CAST(range AS BIGINT) AS f FROM range({d})))) WHERE rn <= {k}),
s0 AS MATERIALIZED (SELECT bg.fold, t, vec_id, 1::BIGINT AS path, CAST(bg.y = 0 AS BIGINT) * m * w AS a, CAST(bg.y = 1 AS BIGINT) * m * w AS b FROM (SELECT * FROM bg JOIN fo ON day <> fold WHERE m > 0) bg JOIN cw ON bg.fold = cw.fold AND bg.y = cw.y)"""]
    for i in range(depth):
        parts.append(f"""
h{i} AS (SELECT fold, t, path, f, bin, count(*) AS n, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM s{i} JOIN ch USING (t, path) JOIN bn USING (vec_id, f) GROUP BY ALL),
w{i} AS (SELECT *, sum(n) OVER l AS ln, sum(a) OVER l AS la, sum(b) OVER l AS lb, sum(n) OVER p AS tn, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM h{i}
  WINDOW l AS (PARTITION BY fold, t, path, f ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY fold, t, path, f)),
g{i} AS (SELECT *, (la * la + lb * lb) / (la + lb) + ((ta - la) * (ta - la) + (tb - lb) * (tb - lb)) / ((ta - la) + (tb - lb)) AS gain FROM w{i} WHERE ln >= {leaf} AND tn - ln >= {leaf} AND ta > 0 AND tb > 0),
b{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, t, path ORDER BY gain DESC, f, bin) AS rn FROM g{i}) WHERE rn = 1),
s{i + 1} AS MATERIALIZED (SELECT fold, t, vec_id, 2 * path + CAST(bn.bin > z.bin AS BIGINT) AS path, s.a, s.b FROM s{i} s JOIN b{i} z USING (fold, t, path) JOIN bn USING (vec_id, f))""")
    value = lambda a, b: f"CAST(round({b} / ({a} + {b}) * {forests.VALUE_UNIT}) AS BIGINT)"
    nodes = [f"SELECT fold, t, 1::BIGINT AS path, {value('sum(a)::DOUBLE', 'sum(b)::DOUBLE')} AS v FROM s0 GROUP BY 1, 2"]
    nodes += [f"SELECT fold, t, 2 * path, {value('la', 'lb')} FROM b{i} UNION ALL SELECT fold, t, 2 * path + 1, {value('(ta - la)', '(tb - lb)')} FROM b{i}" for i in range(depth)]
    parts.append(f"nd AS MATERIALIZED ({' UNION ALL '.join(nodes)}), t0 AS (SELECT day AS fold, t, vec_id, y, 1::BIGINT AS path FROM rw, tr)")
    for i in range(depth):
        parts.append(f"""t{i + 1} AS (SELECT q.fold, q.t, q.vec_id, y, CASE WHEN z.f IS NULL THEN q.path ELSE 2 * q.path + CAST(bn.bin > z.bin AS BIGINT) END AS path
  FROM t{i} q LEFT JOIN b{i} z ON q.fold = z.fold AND q.t = z.t AND q.path = z.path LEFT JOIN bn ON bn.vec_id = q.vec_id AND bn.f = z.f)""")
    parts.append(f"""sc AS MATERIALIZED (SELECT *, CAST(score > 0.5 AS INTEGER) AS predicted FROM (SELECT fold AS model_id, y AS label, sum(v)::DOUBLE / {trees * forests.VALUE_UNIT}::DOUBLE AS score
  FROM t{depth} JOIN nd USING (fold, t, path) GROUP BY fold, vec_id, y))""")
    return ",\n".join(parts)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["lookback_windows"] = f"WITH {EV}, {MK}, {looks(T.LOOKBACK, 3)} SELECT * FROM pos"
    q["window_slice"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}, {joined('pos')}
SELECT window_id, session_id, count(*) AS n_samples, min(t) AS first_t, max(t) AS last_t, {r('sum(x)', 'sum_x')} FROM sl GROUP BY 1, 2"""
    q["time_domain_features"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}, {joined('pos')}
SELECT window_id, session_id, count(*) AS n_samples, {stats()} FROM sl GROUP BY 1, 2 HAVING count(*) >= {T.LEAST}"""
    q["coverage_filter"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}, {joined('pos')},
k AS (SELECT window_id, session_id, count(*) AS n FROM sl GROUP BY 1, 2 HAVING count(*) >= {T.LEAST})
SELECT session_id, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n_samples FROM k GROUP BY 1"""
    q["negative_candidates"] = f"WITH {labelled(T.SHORT)} SELECT session_id, start_t, end_t FROM cand"
    q["negative_sample"] = f"WITH {labelled(T.SHORT)} SELECT * FROM neg"
    q["all_negatives"] = f"WITH {labelled(T.SHORT, True)} SELECT * FROM win"
    q["labelled_dataset"] = f"""WITH {feature_table()} SELECT window_id, session_id, day_str, label, n_samples,
{", ".join(r('x_' + s, 'x_' + s) for s in STATS)} FROM ft"""
    q["windows_per_session"] = f"""WITH {labelled(T.SHORT)} SELECT session_id, count(*) AS n_windows,
CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(1 - label) AS BIGINT) AS n_negative FROM win GROUP BY 1"""
    anchors = f"""{labelled(T.LOOKBACK)},
an AS (SELECT w.window_id, w.session_id, w.label, max(e.t) + 1 AS anchor_end FROM win w
  JOIN ev e ON e.session_id = w.session_id AND e.t >= w.start_t AND e.t < w.end_t GROUP BY 1, 2, 3)"""
    per = ", ".join(f"count(*) FILTER (WHERE e.t >= anchor_end - {n * H}) AS c{n}" for n in (12, 24, 72))
    ok = f"""okk AS (SELECT an.*, {per} FROM an JOIN ev e ON e.session_id = an.session_id AND e.t >= anchor_end - {72 * H} AND e.t < anchor_end
  GROUP BY an.window_id, an.session_id, an.label, an.anchor_end)"""
    spans = f"""sp AS (SELECT window_id, session_id, label, anchor_end, len, anchor_end - len AS start_t, anchor_end AS end_t
  FROM okk, (VALUES ({12 * H}), ({24 * H}), ({72 * H})) AS v(len) WHERE c12 >= 1 AND c24 >= 1 AND c72 >= {T.LEAST})"""
    wide = ", ".join(
        r(f"max(x_{s}) FILTER (WHERE len = {n * H})", f"w{n}_x_{s}") for n in (12, 24, 72) for s in STATS
    )
    q["multi_horizon_features"] = f"""WITH {anchors}, {ok}, {spans}, {joined('sp', extra=', w.len')},
pl AS (SELECT window_id, session_id, label, anchor_end, len, {raw_stats()} FROM sl GROUP BY 1, 2, 3, 4, 5)
SELECT window_id, session_id, label, anchor_end, {wide} FROM pl GROUP BY 1, 2, 3, 4"""
    q["dual_window_anchors"] = f"""WITH {anchors}, {ok}
SELECT window_id, session_id, label, len AS length, anchor_end - len AS start_t, anchor_end AS end_t
FROM okk, (VALUES (CAST({T.SHORT} AS BIGINT)), (CAST({T.LOOKBACK} AS BIGINT))) AS v(len) WHERE c24 >= {T.SHORT_LEAST}"""
    q["jerk_features"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}, {joined('pos', 's0')},
jk AS (SELECT window_id, t, (x - lag(x) OVER (PARTITION BY window_id ORDER BY t)) * 2 AS x FROM s0),
sl AS (SELECT *, lag(sign(x)) OVER (PARTITION BY window_id ORDER BY t) AS before FROM jk),
ns AS (SELECT window_id, count(*) AS n_samples FROM s0 GROUP BY 1)
SELECT window_id, max(n_samples) AS n_samples, {", ".join(r(f"coalesce({STAT_SQL[s]}, 0)", 'jerk_x_' + s) for s in STATS[:5])},
{r("CASE WHEN count(x) > 1 THEN count(*) FILTER (WHERE before <> sign(x)) / CAST(count(x) - 1 AS DOUBLE) ELSE 0.0 END", 'jerk_x_zcr')}
FROM sl JOIN ns USING (window_id) GROUP BY 1"""
    q["trend_features"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}, {joined('pos')}
SELECT window_id, {stats()}, {r('arg_max(x, t) - arg_min(x, t)', 'x_trend')} FROM sl GROUP BY 1"""
    q["dirty_positives"] = f"""WITH {EV}, {MK}, {looks(T.SHORT)}, {joined('pos')},
xt AS (SELECT window_id, session_id, min(t) AS a, max(t) + 1 AS b FROM sl GROUP BY 1, 2 HAVING count(*) >= {T.SHORT_LEAST}),
dt AS (SELECT window_id, EXISTS (SELECT 1 FROM mk WHERE mk.session_id = xt.session_id AND mk.t >= a AND mk.t < b
  AND abs(mk.t - (b + {T.BUFFER})) > {2 * H}) AS dirty FROM xt)
SELECT window_id, dirty, CAST(CASE WHEN dirty THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM dt"""
    q["early_segment"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}
SELECT window_id, count(*) AS n_samples, min(e.t) AS first_t FROM pos p JOIN ev e ON e.session_id = p.session_id
AND e.t >= p.end_t - {T.LOOKBACK} AND e.t < p.end_t - {T.LOOKBACK // 2} GROUP BY 1"""
    q["anchor_points"] = f"""WITH {EV}, {MK}, bounds AS (SELECT session_id, min(t) AS a, max(t) AS b FROM ev GROUP BY 1),
g AS (SELECT session_id, unnest(range(a + {T.SHORT}, b + 1, {5 * H})) AS p FROM bounds)
SELECT session_id, p - {T.SHORT} AS start_t, p AS end_t FROM g
WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.session_id = g.session_id AND abs(p - mk.t) < {T.SHORT})"""
    q["marker_density"] = f"""WITH {EV}, {MK}, en AS (SELECT session_id, arg_min(t, event_id) AS t0, arg_max(t, event_id) AS t1 FROM ev GROUP BY 1),
sz AS (SELECT *, greatest(1, CAST(ceil((t1 - t0) / CAST({D} AS DOUBLE)) AS BIGINT)) AS n FROM en),
gr AS (SELECT session_id, unnest(range(n)) AS bucket FROM sz),
pl AS (SELECT mk.session_id, least(CAST(trunc((t - t0) / CAST({D} AS DOUBLE)) AS BIGINT), n - 1) AS bucket FROM mk JOIN sz USING (session_id)),
ct AS (SELECT session_id, bucket, count(*) AS c FROM pl GROUP BY 1, 2)
SELECT session_id, bucket, coalesce(c, 0) AS n_markers FROM gr LEFT JOIN ct USING (session_id, bucket)"""
    q["context_window"] = f"""WITH {RUNS} SELECT r.session_id, start_t - {6 * H} AS start_t, end_t + {6 * H} AS end_t, count(*) AS n_samples,
min(e.t) AS first_t, max(e.t) AS last_t FROM runs r JOIN ev e ON e.session_id = r.session_id AND e.t BETWEEN start_t - {6 * H} AND end_t + {6 * H} GROUP BY 1, 2, 3"""
    q["session_day_join"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)}
SELECT window_id, session_id, coalesce('n' || c_nationkey, 'unknown') AS day_str FROM pos
LEFT JOIN customer ON c_custkey * 2 = session_id"""
    q["nearest_match"] = f"""WITH {EV}, pr AS (SELECT a.day_str, a.event_id AS case_idx, b.event_id AS control_idx, abs(b.t - a.t) AS distance,
row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), b.event_id) AS rn
FROM ev a JOIN ev b ON a.day_str = b.day_str AND a.event_type = 'error' AND b.event_type <> 'error')
SELECT day_str, case_idx, control_idx, distance FROM pr WHERE rn = 1"""
    q["outcome_match"] = f"""WITH {EV}, al AS (SELECT session_id, t, event_id FROM ev WHERE event_type = 'purchase'),
mo AS (SELECT session_id, t, event_id, event_type FROM ev WHERE event_type = 'error')
SELECT m.session_id, m.event_id AS outcome_id, m.t, m.event_type AS event,
CASE WHEN m.t - a.t <= {24 * H} THEN a.event_id END AS matched_alert_idx, m.t - a.t AS since_alert
FROM mo m ASOF LEFT JOIN al a ON m.session_id = a.session_id AND m.t >= a.t"""
    q["stream_outcomes"] = f"""WITH {EV}, al AS (SELECT session_id, t, max(event_id) AS event_id FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
mo AS (SELECT session_id, t, event_id, event_type FROM ev WHERE event_type = 'error')
SELECT m.session_id, m.event_id AS outcome_id, m.t, m.event_type AS event,
CASE WHEN m.t - a.t <= {24 * H} THEN a.event_id END AS matched_alert_idx, CASE WHEN m.t - a.t <= {240 * H} THEN m.t - a.t END AS since_alert
FROM mo m ASOF LEFT JOIN al a ON m.session_id = a.session_id AND m.t >= a.t"""
    q["positional_zip"] = f"""WITH {EV}, {MK}, {looks(T.BEAT_SPAN)},
st AS (SELECT p.window_id, e.event_type, e.value, row_number() OVER (PARTITION BY p.window_id, e.event_type ORDER BY e.t) AS rn
  FROM pos p JOIN ev e ON e.session_id = p.session_id AND e.t >= p.start_t AND e.t < p.end_t WHERE e.event_type IN ('click', 'view'))
SELECT a.window_id, count(*) AS n, {r('sum(a.value * b.value)', 'dot')} FROM st a JOIN st b ON a.window_id = b.window_id AND a.rn = b.rn
AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1 HAVING count(*) >= 3"""
    q["source_override"] = """SELECT s_suppkey, 'exp-' || s_suppkey AS name, 'exp-' || CASE s_suppkey WHEN 5 THEN 6 WHEN 6 THEN 5 WHEN 8 THEN 9 WHEN 9 THEN 8
ELSE s_suppkey END AS source FROM supplier"""
    q["resume_antijoin"] = """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS
(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""
    q["monotonic_audit"] = f"""WITH {JUMPS}, sp AS (SELECT session_id, arg_max(t, file_offset) - arg_min(t, file_offset) AS span FROM sh GROUP BY 1)
SELECT session_id, count(*) FILTER (WHERE t < prev_t) AS n_backward, count(*) FILTER (WHERE t < prev_t AND prev_t > 2100 AND t < 1500) AS n_wraps,
count(*) FILTER (WHERE t < prev_t AND NOT (prev_t > 2100 AND t < 1500)) AS n_anomalies, max(span) AS span FROM lg JOIN sp USING (session_id) GROUP BY 1"""
    q["anomaly_sample"] = f"""WITH {JUMPS}, an AS (SELECT session_id, file_offset, prev_t, t AS next_t, prev_t - t AS "drop",
row_number() OVER (PARTITION BY session_id ORDER BY file_offset) AS rn FROM lg WHERE t < prev_t)
SELECT session_id, file_offset, prev_t, next_t, "drop" FROM an WHERE rn <= 20"""
    q["duplicate_audit"] = f"""WITH {SHIP}, lg AS (SELECT *, lag(t) OVER w AS pt, lag(l_returnflag) OVER w AS pr, lag(l_linestatus) OVER w AS pl FROM sh
WINDOW w AS (PARTITION BY session_id ORDER BY file_offset))
SELECT session_id, count(*) FILTER (WHERE t = pt AND pr = l_returnflag AND pl = l_linestatus) AS n_exact,
count(*) FILTER (WHERE t = pt AND NOT (pr = l_returnflag AND pl = l_linestatus)) AS n_conflicting FROM lg GROUP BY 1"""
    q["threshold_flags"] = f"""WITH {EV}, med AS (SELECT session_id, median(value) AS m FROM ev GROUP BY 1)
SELECT session_id, event_id, value, value > 3.0 * m AS above FROM ev JOIN med USING (session_id)"""
    q["threshold_runs"] = f"WITH {RUNS} SELECT session_id, start_t, end_t, peak FROM runs"
    q["merge_runs"] = f"""WITH {RUNS},
rc AS (SELECT *, max(end_t) OVER (PARTITION BY session_id ORDER BY start_t, end_t, peak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs),
gp AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_t - reach > {12 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_t, end_t, peak ROWS UNBOUNDED PRECEDING) AS g FROM rc)
SELECT session_id, min(start_t) AS start_t, max(end_t) AS end_t, max(peak) AS peak FROM gp GROUP BY session_id, g HAVING max(end_t) - min(start_t) >= {6 * H}"""
    q["rolling_window"] = f"""WITH {EV} SELECT session_id, event_id, t, x, count(*) OVER w AS n, {r('avg(x) OVER w', 'avg_x')}, max(x) OVER w AS max_x FROM ev
WINDOW w AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN {T.LOOKBACK} PRECEDING AND CURRENT ROW)""".replace(" max(x) OVER w AS max_x", f" {r('max(x) OVER w', 'max_x')}").replace("event_id, t, x,", f"event_id, t, {r('x', 'x')},")
    q["session_median"] = f"""WITH {EV} SELECT event_type, {r('quantile_cont(value, 0.025)', 'p025')}, {r('median(value)', 'median')}, {r('quantile_cont(value, 0.975)', 'p975')} FROM ev GROUP BY 1"""
    q["manifest_pivot"] = f"""WITH {EV} SELECT session_id, {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("click", "error", "purchase", "signup", "view"))},
min(t) AS first_t, max(t) AS last_t FROM ev GROUP BY 1"""
    q["name_clock_check"] = f"""WITH {EV}, nm AS (SELECT day_str || '-' || CAST((t // {H}) % 24 AS BIGINT) || '-' || json_extract_string(props, '$.k') ||
CASE WHEN event_type = 'view' THEN '' ELSE 'pm_1' END AS session_id FROM ev),
mt AS (SELECT session_id, regexp_matches(session_id, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{1,2}})-(\\d+)(am|pm)') AS hit,
regexp_extract(session_id, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{1,2}})-(\\d+)(am|pm)', 2) AS h,
regexp_extract(session_id, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{1,2}})-(\\d+)(am|pm)', 3) AS m FROM nm)
SELECT session_id, hit AS pattern_match, CASE WHEN hit THEN h END AS parsed_hour, CASE WHEN hit THEN m END AS parsed_minute,
CASE WHEN hit THEN TRY_CAST(m AS BIGINT) <= 59 AND TRY_CAST(h AS BIGINT) BETWEEN 1 AND 12 END AS valid_clock_time, count(*) AS n FROM mt GROUP BY 1, 2, 3, 4, 5"""
    q["mm_ss_parse"] = f"""WITH {EV} SELECT event_id, CAST(trunc(CAST(t // 1000 AS DOUBLE) + floor(value) * 60 * 1000 + (value - floor(value)) * 100 * 1000) AS BIGINT) AS event_ms FROM ev"""
    q["gapped_ibi"] = f"WITH {BEATS} SELECT window_id, {r('t', 't', 3)}, {r('ibi', 'ibi', 3)} FROM ib"
    q["ectopic_rejection"] = f"WITH {rejected(0.6)} SELECT window_id, {r('t', 't', 3)}, {r('ibi', 'ibi', 3)}, {r('local_median', 'local_median', 3)}, valid FROM ck"
    q["hr_trend"] = f"WITH {heart(0.6)} SELECT window_id, n_ibis, {r('raw_hr_mean', 'raw_hr_mean', 4)}, plausible_hr, n_valid, {r('hr_trend_mean', 'hr_trend_mean', 4)}, {r('hr_trend_slope', 'hr_trend_slope', 4)} FROM hf"
    q["rmssd_sdnn"] = f"WITH {heart(0.6)} SELECT window_id, {r('rmssd_clean', 'rmssd_clean', 4)}, {r('sdnn_clean', 'sdnn_clean', 4)} FROM hf"
    q["quality_funnel"] = f"""WITH {heart(0.2)}, sg AS (SELECT window_id, count(*) AS n FROM bt GROUP BY 1),
al AS (SELECT n >= 10 AND coalesce(plausible_hr, false) AS p, n >= 10 AND hr_trend_slope IS NOT NULL AS tk,
  n >= 10 AND rmssd_clean IS NOT NULL AND sdnn_clean IS NOT NULL AS hk FROM sg LEFT JOIN hf USING (window_id))
SELECT count(*) AS n_anchors, count(*) FILTER (WHERE p) AS n_plausible, count(*) FILTER (WHERE tk) AS n_trend_ok,
count(*) FILTER (WHERE hk) AS n_hrv_ok, count(*) FILTER (WHERE tk AND hk) AS n_both_ok FROM al"""
    q["median_impute"] = f"""WITH {heart(0.6)} SELECT window_id, {", ".join(r(f"coalesce({n}, median({n}) OVER ())", n, 4) for n in ("hr_trend_mean", "hr_trend_slope", "sdnn_clean"))} FROM hf"""
    q["fold_median_impute"] = f"""WITH {heart(0.6)}, rw AS (SELECT window_id, hr_trend_mean, sdnn_clean, CAST(split_part(window_id, ':', 2) AS BIGINT) % 3 AS part FROM hf),
md2 AS (SELECT fold, median(hr_trend_mean) AS m1, median(sdnn_clean) AS m2 FROM rw, range(3) AS f(fold) WHERE part <> fold GROUP BY 1)
SELECT window_id, fold, {r("coalesce(hr_trend_mean, m1)", "hr_trend_mean", 4)}, {r("coalesce(sdnn_clean, m2)", "sdnn_clean", 4)} FROM rw, md2"""
    q["standardize"] = f"""WITH {feature_table()} SELECT window_id, {", ".join(r(f"(x_{s} - avg(x_{s}) OVER ()) / CASE WHEN stddev_pop(x_{s}) OVER () = 0 THEN 1 ELSE stddev_pop(x_{s}) OVER () END", 'x_' + s) for s in STATS)} FROM ft"""
    q["fold_scalers"] = f"""WITH {feature_table()}, ds AS (SELECT DISTINCT day_str AS fold FROM ft), lf AS ({" UNION ALL ".join(f"SELECT day_str, 'x_{s}' AS feature, x_{s} AS v FROM ft" for s in STATS)})
SELECT fold, feature, count(v) AS n, {r('avg(v)', 'mean', 7)}, {r('CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END', 'scale', 7)} FROM lf JOIN ds ON day_str <> fold GROUP BY 1, 2"""
    q["class_weights"] = f"""WITH {EV}, c AS (SELECT day_str, CAST(event_type = 'error' AS INTEGER) AS label, count(*) AS n_class FROM ev GROUP BY 1, 2)
SELECT day_str, label, n_class, {r('sum(n_class) OVER (PARTITION BY day_str) / (2.0 * n_class)', 'weight')} FROM c""".replace("sum(n_class) OVER (PARTITION BY day_str) /", "CAST(sum(n_class) OVER (PARTITION BY day_str) AS DOUBLE) /")
    q["roc_auc"] = f"WITH {SCORED}, {auc('sc', 'day_str')} SELECT day_str, {r('auc', 'auc')}, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM aucs"
    q["roc_auc_total"] = f"WITH {SCORED}, {auc('sc', '')} SELECT {r('auc', 'auc')}, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM aucs"
    q["prf_metrics"] = f"WITH {SCORED}, cf AS (SELECT day_str, {CONF} FROM sc GROUP BY 1) SELECT *, {r(F1, 'f1')}, {r(PRECISION, 'precision')}, {r(RECALL, 'recall')} FROM cf"
    q["class_report"] = f"""WITH {SCORED}, bo AS (SELECT day_str, CAST(c AS INTEGER) AS class, CAST(predicted = c AS INTEGER) AS predicted, CAST(label = c AS INTEGER) AS label FROM sc, range(2) AS k(c)),
cf AS (SELECT day_str, class, {CONF} FROM bo GROUP BY 1, 2)
SELECT day_str, class, {r(PRECISION, 'precision')}, {r(RECALL, 'recall')}, {r(F1, 'f1')}, tp + fn AS support FROM cf"""
    q["cv_summary"] = f"""WITH {FOLDS} SELECT count(*) AS n_folds, {r('avg(auc)', 'mean_auc')}, {r('stddev_pop(auc)', 'std_auc')}, {r('avg(f1)', 'mean_f1')}, {r('stddev_pop(f1)', 'std_f1')} FROM folds"""
    q["topk_configs"] = f"WITH {FOLDS} SELECT day_str AS config, {r('auc', 'mean_auc')} FROM folds ORDER BY auc DESC, day_str LIMIT 5"
    q["class_histogram"] = f"""WITH {feature_table()}, lf AS ({" UNION ALL ".join(f"SELECT label, 'x_{s}' AS feature, x_{s} AS v FROM ft" for s in ("mean", "max"))}),
sp AS (SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM lf)
SELECT feature, label, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 30), 29) END AS BIGINT) AS bin, count(*) AS n FROM sp GROUP BY 1, 2, 3"""
    q["holdout_split"] = f"""WITH {feature_table()} SELECT day_str = (SELECT max(day_str) FROM ft) AS is_test, label, count(*) AS n, max(day_str) AS last_day FROM ft GROUP BY 1, 2"""
    q["dataset_profile"] = f"WITH {feature_table()} SELECT count(*) AS n, {r('avg(label)', 'positive_rate')}, count(DISTINCT day_str) AS n_days FROM ft"
    flips = f"""{EV}, fr AS (SELECT 'accel_y_' || day_str AS feature, avg(x) AS baseline, avg(x) FILTER (WHERE event_type = 'click') AS original FROM ev GROUP BY 1),
f2 AS (SELECT *, -original AS flipped FROM fr), f3 AS (SELECT *, abs(original - baseline) AS d0, abs(flipped - baseline) AS d1 FROM f2),
f4 AS (SELECT *, CASE WHEN d1 < d0 * 0.8 THEN 'IMPROVED' WHEN d1 > d0 * 1.2 THEN 'WORSENED' ELSE '~unchanged' END AS outcome FROM f3)"""
    q["flip_outcomes"] = f"""WITH {flips} SELECT feature, {r('baseline', 'baseline', 5)}, {r('original', 'original', 5)}, {r('flipped', 'flipped', 5)}, {r('d0', 'diff_original', 5)}, {r('d1', 'diff_flipped', 5)},
outcome, sign(baseline) = sign(original) AS same_sign_original, sign(baseline) = sign(flipped) AS same_sign_flipped FROM f4"""
    q["flip_summary"] = f"""WITH {flips}, n AS (SELECT count(*) FILTER (WHERE outcome = 'IMPROVED') AS i, count(*) FILTER (WHERE outcome = 'WORSENED') AS w FROM f4)
SELECT i AS n_improved, w AS n_worsened, i AS accel_yz_improved, CAST(0 AS BIGINT) AS other_worsened, i >= 1 AND w <= 2 AS helps FROM n"""
    q["coefficient_shift"] = f"""WITH {EV}, m AS (SELECT day_str AS feature, avg(x) FILTER (WHERE event_type = 'click') AS b, avg(x) FILTER (WHERE event_type = 'view') AS i FROM ev GROUP BY 1)
SELECT feature, {r('b', 'baseline_coef')}, {r('i', 'informed_coef')}, {r('abs(i - b)', 'abs_diff')} FROM m WHERE b IS NOT NULL AND i IS NOT NULL ORDER BY abs(i - b) DESC, feature LIMIT 10"""
    side = lambda k: f"SELECT DISTINCT session_id || ':' || day_str AS day_str FROM ev WHERE event_type = '{k}'"
    q["day_set_difference"] = f"""WITH {EV}, a AS ({side('click')}), b AS ({side('view')})
SELECT day_str, 'left' AS only_in FROM a WHERE day_str NOT IN (SELECT day_str FROM b) UNION ALL SELECT day_str, 'right' FROM b WHERE day_str NOT IN (SELECT day_str FROM a)"""
    q["matched_population"] = f"""WITH {EV}, {MK}, {looks(T.SHORT, name='p1')}, {looks(T.LOOKBACK, name='p2')},
a AS (SELECT window_id, max(x) AS m FROM p1 p JOIN ev e ON e.session_id = p.session_id AND e.t >= p.start_t AND e.t < p.end_t GROUP BY 1),
b AS (SELECT window_id, max(x) AS m FROM p2 p JOIN ev e ON e.session_id = p.session_id AND e.t >= p.start_t AND e.t < p.end_t GROUP BY 1)
SELECT coalesce(a.window_id, b.window_id) AS window_id FROM a FULL JOIN b ON a.window_id = b.window_id WHERE a.m IS NULL OR b.m IS NULL OR abs(a.m - b.m) > 1e-9 * (1 + abs(b.m))"""
    q["day_draws"] = f"WITH {EV}, dd AS (SELECT day_str AS day FROM ev), {draws('dd')} SELECT rep, slot, day FROM drawn"
    q["resample_folds"] = f"""WITH dd AS (SELECT 'd' || (vec_id % 5) AS day FROM embeddings), {draws('dd')},
ct AS (SELECT rep, day, count(*) AS mult FROM drawn GROUP BY 1, 2)
SELECT a.rep, a.day AS test_day, string_agg(b.day || '*' || b.mult, ',' ORDER BY b.day) AS train_key FROM ct a JOIN ct b ON a.rep = b.rep AND a.day <> b.day GROUP BY 1, 2"""
    reps = f"{EV}, dd AS (SELECT day_str AS day FROM ev), {draws('dd')}, {value_reps('error', 'a')}, {value_reps('click', 'b')}"
    q["bootstrap_ci"] = f"""WITH {reps} SELECT count(v) AS n_valid, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.025)', 'ci_low')}, {r('quantile_cont(v, 0.975)', 'ci_high')} FROM repa"""
    q["paired_diff"] = f"""WITH {reps}, df AS (SELECT b.v - a.v AS d FROM repa a JOIN repb b USING (rep))
SELECT count(*) AS n_paired, {r('avg(d)', 'mean_diff')}, {r('quantile_cont(d, 0.025)', 'ci_low')}, {r('quantile_cont(d, 0.975)', 'ci_high')},
{r('100.0 * avg(CASE WHEN d > 0 THEN 1 ELSE 0 END)', 'pct_better')}, false AS cross_population, quantile_cont(d, 0.025) > 0 AS significant FROM df"""
    q["rf_cv"] = f"""WITH {forest_scores()}, {auc('sc', 'model_id')}, cf AS (SELECT model_id, {CONF} FROM sc GROUP BY 1)
SELECT model_id, {r('auc', 'auc')}, {r(F1, 'f1')} FROM aucs JOIN cf USING (model_id)"""
    q["naive_bayes_cv"] = f"""WITH {naive_bayes()}, {auc('sc', 'model_id')}, cf AS (SELECT model_id, {CONF} FROM sc GROUP BY 1)
SELECT model_id, {r('auc', 'auc')}, {r(F1, 'f1')} FROM aucs JOIN cf USING (model_id)"""
    q["window_bayes_cv"] = f"""WITH {feature_table()}, {window_bayes()}, {auc('sc', 'model_id')}, cf AS (SELECT model_id, {CONF} FROM sc GROUP BY 1)
SELECT model_id, {r('auc', 'auc')}, {r(F1, 'f1')} FROM aucs JOIN cf USING (model_id) WHERE auc IS NOT NULL"""
    q["fft_features"] = f"""WITH {EV}, {MK}, {looks(T.LOOKBACK)},
sa AS (SELECT p.window_id, e.x, row_number() OVER (PARTITION BY p.window_id ORDER BY e.t) - 1 AS j, count(*) OVER (PARTITION BY p.window_id) AS n
  FROM pos p JOIN ev e ON e.session_id = p.session_id AND e.t >= p.start_t AND e.t < p.end_t),
bn AS (SELECT *, unnest(range(n // 2 + 1)) AS k FROM sa),
ft AS (SELECT window_id, n, k, k * 16.0 / n AS f, power(sum(x * cos(2 * pi() * ((k * j) % n) / n)), 2) + power(sum(x * sin(2 * pi() * ((k * j) % n) / n)), 2) AS p FROM bn GROUP BY 1, 2, 3)
SELECT window_id, n AS n_samples, {r("CASE WHEN n < 4 THEN 0 ELSE arg_max(f, p) END", "x_dominant_freq")},
{r("CASE WHEN n < 4 THEN 0 ELSE coalesce(sum(p) FILTER (WHERE f < 5), 0) * 16.0 / n END", "x_power_0_5hz", 2)},
{r("CASE WHEN n < 4 THEN 0 ELSE coalesce(sum(p) FILTER (WHERE f >= 5 AND f < 15), 0) * 16.0 / n END", "x_power_5_15hz", 2)} FROM ft GROUP BY window_id, n"""
    q["feature_parity"] = "SELECT 'x_' || s AS feature, true AS agrees FROM (VALUES ('mean'), ('std'), ('min'), ('max'), ('rms'), ('zcr')) AS v(s)"
    q["packet_decode"] = f"""WITH {EV}, k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key,
row_number() OVER (PARTITION BY session_id, day_str ORDER BY t) - 1 AS i FROM ev)
SELECT session_id || '_' || day_str AS session_id, i * 40 + 2 AS file_offset, (t // 1000) % 4294967296 AS timestamp_ms,
CAST(floor(x * 10) AS SMALLINT) AS accel_x, CAST(event_id % 30000 AS SMALLINT) AS accel_y, CAST(-(event_id % 30000) AS SMALLINT) AS accel_z,
CAST(key AS SMALLINT) AS gyro_x, CAST(-key AS SMALLINT) AS gyro_y, CAST(length(event_type) AS SMALLINT) AS gyro_z,
CAST(floor(value * 1000) AS BIGINT) AS ppg_ir, event_id AS ppg_red, CAST(1 + (event_id % 8) / 8.0 AS DOUBLE) AS ambient_c, CAST(1 + (event_id % 4) / 4.0 AS DOUBLE) AS object_c FROM k"""
    q["cooldown_alerts"] = f"""WITH RECURSIVE {EV}, hot AS (SELECT session_id, event_id, t FROM ev WHERE value / 100.0 >= 0.3),
fire AS (SELECT session_id, min(t) AS t FROM hot GROUP BY 1 UNION ALL
  SELECT h.session_id, min(h.t) AS t FROM fire f JOIN hot h ON h.session_id = f.session_id AND h.t >= f.t + {24 * H} GROUP BY h.session_id)
SELECT ev.session_id, ev.event_id AS eval_id, f.t IS NOT NULL AS alert_fired, h.t IS NOT NULL AND f.t IS NULL AS suppressed_by_cooldown
FROM ev LEFT JOIN hot h ON h.event_id = ev.event_id LEFT JOIN fire f ON f.session_id = ev.session_id AND f.t = ev.t AND h.t IS NOT NULL"""
    q["live_scoring"] = f"""WITH {EV}, tk AS (SELECT session_id, min(t) AS t FROM ev GROUP BY session_id, t // {D}),
w AS (SELECT tk.session_id, tk.t, count(*) AS n, avg(x) AS m, max(x) AS mx FROM tk JOIN ev ON ev.session_id = tk.session_id AND ev.t BETWEEN tk.t - {T.LOOKBACK} AND tk.t GROUP BY 1, 2)
SELECT 'e:' || session_id || ':' || t AS window_id, session_id, n AS n_samples, {r('1 / (1 + exp(-(0.1 + (m - 0.0) / 20.0 * 1.0 + (mx - 100.0) / 50.0 * 0.5)))', 'probability')} FROM w WHERE n >= {T.LEAST}"""
    slide = f"""{EV}, sl AS (SELECT session_id, x, t, (t // {D} + 1 + k) * {D} AS window_end FROM ev, range(3) AS s(k))"""
    columns = f"count(*) AS n_samples, {r('avg(x)', 'x_mean')}, {r('stddev_pop(x)', 'x_std')}, {r('min(x)', 'x_min')}, {r('max(x)', 'x_max')}, {r('sqrt(avg(x * x))', 'x_rms')}"
    q["sliding_features"] = f"WITH {slide} SELECT session_id, window_end, {columns} FROM sl GROUP BY 1, 2 HAVING count(*) >= {T.LEAST}"
    q["stream_sliding_features"] = f"""WITH {slide} SELECT session_id, window_end, {columns} FROM sl
WHERE window_end <= (SELECT max(t) // 1000 * 1000 - 10000000 FROM ev) GROUP BY 1, 2 HAVING count(*) >= {T.LEAST}"""
    table = f"SELECT f AS fold, {r('a', 'intercept')}, {r('b', 'coef')} FROM fin"
    q["logistic_fit"] = f"WITH RECURSIVE {logistic_fit(0.01, 1.0)} {table}"
    q["lasso_fit"] = f"WITH RECURSIVE {logistic_fit(0.1, 0.5, 0.5)} {table}"
    q["informed_fit"] = f"WITH RECURSIVE {logistic_fit(1.0, 40.0, prior=0.02, balanced=False)} {table}"
    q["wald_errors"] = f"WITH RECURSIVE {logistic_fit(1.0, 0.0, balanced=False, everything=True)} SELECT {r('b', 'coef')}, {r('1 / sqrt(curve)', 'se')} FROM fin"
    q["logistic_fold_scores"] = f"WITH RECURSIVE {logistic_fit(1.0, 1.0)}, {fit_scores('>')}"
    q["conditional_fold_scores"] = f"WITH RECURSIVE {conditional_fit()}, {fit_scores('>=')}"
    q["emg_envelope_3hz"] = f"WITH RECURSIVE {muscle_filter(recurrence.butterworth_low(2, 3.0, 500.0)[0])} SELECT session_id, t, {r('envelope', 'envelope', 4)} FROM env"
    q["emg_envelope"] = f"WITH RECURSIVE {muscle_filter()} SELECT session_id, t, {r('envelope', 'envelope', 4)} FROM env"
    q["emg_candidates"] = f"""WITH RECURSIVE {muscle_filter()},
md AS (SELECT session_id, median(envelope) AS m FROM env GROUP BY 1), fl AS (SELECT session_id, t, v, envelope > 1.02 * m AS above FROM env JOIN md USING (session_id)),
op AS (SELECT *, CASE WHEN above AND NOT coalesce(lag(above) OVER (PARTITION BY session_id ORDER BY t), false) THEN 1 ELSE 0 END AS o FROM fl),
nb AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY t) AS run FROM op),
rn AS (SELECT session_id, min(t) AS a, max(t) AS b, max(v) AS peak FROM nb WHERE above GROUP BY session_id, run),
rc AS (SELECT *, max(b) OVER (PARTITION BY session_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rn),
gp AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > {12 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY a) AS g FROM rc)
SELECT session_id, min(a) AS start_t, max(b) AS end_t, CAST(max(peak) AS INTEGER) AS peak FROM gp GROUP BY session_id, g HAVING max(b) - min(a) >= {6 * H}"""
    q["bayes_bootstrap"] = bayes_bootstrap()
    return q
