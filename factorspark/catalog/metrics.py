"""Evaluation metrics and pools on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators import metrics as M
from ..operators import pool as K
from ..operators import windows as T
from ..plans.evaluate import add_factors, factor_rows
from .base import q6, query, r6, table
from .factors import windows as window_sql
from .fixtures import FORWARD, PANEL_SQL, POOL, panel

CORR6 = (
    "CASE WHEN count(close) OVER w6 = 6 THEN covar_pop(close, volume) OVER w6 * 6 / CASE WHEN var_pop(close) OVER w6 * 6 < 1e-6 "
    "OR var_pop(volume) OVER w6 * 6 < 1e-6 THEN 1.0 ELSE sqrt(var_pop(close) OVER w6 * 6 * var_pop(volume) OVER w6 * 6) END END"
)
FACTORS_SQL = f"""{PANEL_SQL},
factors AS (
  SELECT symbol, date, date_idx,
         CASE WHEN count(volume) OVER w3 = 3 THEN avg(volume) OVER w3 END / nullif(close, 0) AS a0,
         high - low AS a1,
         CASE WHEN count(close) OVER w3 = 3 THEN stddev_samp(close) OVER w3 END AS a2,
         {CORR6} AS a3,
         CASE WHEN vwap IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY vwap ASC NULLS LAST, symbol) - 1)
              / CAST(count(vwap) OVER (PARTITION BY date) AS DOUBLE) END AS a4,
         lead(close, 1) OVER s / nullif(close, 0) - 1.0 AS y
  FROM panel {window_sql(3, 6)}),
z AS (SELECT symbol, date, date_idx, """ + ", ".join(
    f"coalesce(({c} - avg({c}) OVER d) / nullif(stddev_pop({c}) OVER d, 0), 0) AS z{c}" for c in ("a0", "a1", "a2", "a3", "a4", "y")
) + """ FROM factors WINDOW d AS (PARTITION BY date)),
scored AS (SELECT *, 0.3*za0 - 0.2*za1 + 0.25*za2 + 0.15*za3 + 0.4*za4 AS score FROM z)"""


def pearson(x: str, y: str) -> str:
    """Correlation of two columns without missing values, unscaled when one hardly varies."""
    return f"covar_pop({x}, {y}) / CASE WHEN stddev_pop({x}) < 1e-3 OR stddev_pop({y}) < 1e-3 THEN 1.0 ELSE stddev_pop({x}) * stddev_pop({y}) END"


def ranks(x: str) -> str:
    return f"rank() OVER (PARTITION BY date ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"


DAILY_SQL = f"""{FACTORS_SQL},
r AS (SELECT date, date_idx, za0, score, zy, {ranks('score')} AS rs, {ranks('zy')} AS ry, {ranks('za0')} AS r0 FROM scored),
daily AS (SELECT date, {pearson('score', 'zy')} AS ic, {pearson('rs', 'ry')} AS rank_ic,
                 {pearson('za0', 'zy')} AS ic0, {pearson('r0', 'ry')} AS rank_ic0 FROM r GROUP BY date)"""

ALPHA = "Div(Mean($volume,3d),$close)"


def alpha(spark, folder, formula: str = ALPHA):
    p = add_factors(panel(spark, folder), {"a": formula, "y": FORWARD})
    return p.over(p.df.select("symbol", "date", "date_idx", "a", "y"))


@query("forward_return", f"WITH {PANEL_SQL} SELECT symbol, date, {q6('lead(close, 2) OVER s / nullif(close, 0) - 1.0')} AS value FROM panel {window_sql()}")
def forward_return(spark, folder):
    p = add_factors(panel(spark, folder), {"value": M.forward_return(2)})
    return p.df.select("symbol", "date", r6("value").alias("value"))


@query("ic_daily", f"WITH {DAILY_SQL} SELECT date, {q6('ic0')} AS ic FROM daily")
def ic_daily(spark, folder):
    return M.alpha_daily_ic(alpha(spark, folder), "a", "y").select("date", r6("ic").alias("ic"))


@query(
    "ic_daily_raw",
    f"""WITH {FACTORS_SQL}, p AS (SELECT date, CASE WHEN y IS NOT NULL THEN a0 END AS x, CASE WHEN a0 IS NOT NULL THEN y END AS y FROM factors)
SELECT date, {q6(pearson('x', 'y'))} AS ic FROM p GROUP BY date""",
)
def ic_daily_raw(spark, folder):
    return M.daily_ic(alpha(spark, folder).df, "a", "y").select("date", r6("ic").alias("ic"))


@query("rank_ic_daily", f"WITH {DAILY_SQL} SELECT date, {q6('rank_ic0')} AS rank_ic FROM daily")
def rank_ic_daily(spark, folder):
    return M.alpha_daily_rank_ic(alpha(spark, folder), "a", "y").select("date", r6("rank_ic").alias("rank_ic"))


@query(
    "rank_ic_daily_raw",
    f"""WITH {FACTORS_SQL}, p AS (SELECT date, a0 AS x, y FROM factors WHERE a0 IS NOT NULL AND y IS NOT NULL),
r AS (SELECT date, {ranks('x')} AS rx, {ranks('y')} AS ry FROM p) SELECT date, {q6(pearson('rx', 'ry'))} AS rank_ic FROM r GROUP BY date""",
)
def rank_ic_daily_raw(spark, folder):
    return M.daily_rank_ic(alpha(spark, folder), "a", "y").select("date", r6("rank_ic").alias("rank_ic"))


@query(
    "ic_summary",
    f"""WITH {DAILY_SQL} SELECT {q6('avg(ic0)')} AS ic, {q6('avg(ic0) / nullif(stddev_samp(ic0), 0)')} AS icir,
{q6('avg(rank_ic0)')} AS rank_ic, {q6('avg(rank_ic0) / nullif(stddev_samp(rank_ic0), 0)')} AS rank_icir FROM daily""",
)
def ic_summary(spark, folder):
    out = M.alpha_summary(alpha(spark, folder), "a", "y")
    return out.select(*[r6(c).alias(c) for c in ("ic", "icir", "rank_ic", "rank_icir")])


@query("ic_lower_bound", f"WITH {DAILY_SQL} SELECT {q6('avg(ic0) - 0.5 * stddev_samp(ic0)')} AS lcb FROM daily")
def ic_lower_bound(spark, folder):
    return M.lower_confidence_bound(M.alpha_daily_ic(alpha(spark, folder), "a", "y"), 0.5).select(r6("lcb").alias("lcb"))


_PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]
MUTUAL_SQL = f"{FACTORS_SQL}, mutual AS (" + " UNION ALL ".join(
    f"SELECT date, {i} AS i, {j} AS j, {pearson(f'za{i}', f'za{j}')} AS ic FROM z GROUP BY date" for i, j in _PAIRS
) + ")"


def pool_panel(spark, folder):
    names = {f"a{i}": f for i, f in enumerate(POOL)}
    p = add_factors(panel(spark, folder), {**names, "y": FORWARD})
    return p.over(p.df.select("symbol", "date", "date_idx", *names, "y"))


@query("mutual_ic_daily", f"WITH {MUTUAL_SQL} SELECT date, i, j, {q6('ic')} AS ic FROM mutual")
def mutual_ic_daily(spark, folder):
    return M.mutual_ic_daily(pool_panel(spark, folder), [f"a{i}" for i in range(5)]).select("date", "i", "j", r6("ic").alias("ic"))


@query(
    "mutual_ic_matrix",
    f"""WITH {MUTUAL_SQL}, m AS (SELECT i, j, avg(ic) AS ic FROM mutual GROUP BY 1, 2)
SELECT i, j, {q6('ic')} AS ic FROM (SELECT i, j, ic FROM m UNION ALL SELECT j, i, ic FROM m UNION ALL SELECT k, k, 1.0 FROM range(5) t(k))""".replace("SELECT k, k,", "SELECT CAST(k AS INTEGER), CAST(k AS INTEGER),"),
)
def mutual_ic_matrix(spark, folder):
    return M.mutual_ic_matrix(pool_panel(spark, folder), [f"a{i}" for i in range(5)]).select("i", "j", r6("ic").alias("ic"))


@query("mutual_ic_blocks", f"WITH {MUTUAL_SQL} SELECT date, i, j, {q6('ic')} AS ic FROM mutual")
def mutual_ic_blocks(spark, folder):
    """The same pairs by the route taken for many formulas."""
    cols = [f"a{i}" for i in range(5)]
    z = X.zscore(pool_panel(spark, folder), cols)
    return M.unpacked(M.daily_correlation_rows(z, cols, M.Pairs(5))).select("date", "i", "j", r6("ic").alias("ic"))


@query("pool_scores", f"WITH {FACTORS_SQL} SELECT symbol, date, {q6('score')} AS score, {q6('zy')} AS target FROM scored")
def pool_scores(spark, folder):
    out = M.pool_scores(panel(spark, folder), POOL, FORWARD).df
    return out.select("symbol", "date", r6("score").alias("score"), r6("target").alias("target"))


@query("pool_daily", f"WITH {DAILY_SQL} SELECT date, {q6('ic')} AS ic, {q6('rank_ic')} AS rank_ic FROM daily")
def pool_daily(spark, folder):
    return M.pool_daily(panel(spark, folder), POOL, FORWARD).select("date", r6("ic").alias("ic"), r6("rank_ic").alias("rank_ic"))


@query(
    "pool_metrics",
    f"""WITH {DAILY_SQL} SELECT {q6('avg(ic)')} AS ic, {q6('avg(ic) / nullif(stddev_samp(ic), 0)')} AS icir,
{q6('avg(rank_ic)')} AS rank_ic, {q6('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)')} AS rank_icir FROM daily""",
)
def pool_metrics(spark, folder):
    out = M.pool_metrics(panel(spark, folder), POOL, FORWARD)
    return out.select(*[r6(c).alias(c) for c in ("ic", "icir", "rank_ic", "rank_icir")])


SEGMENTS = [("a", "1995-01-01", "1996-12-31"), ("b", "1997-01-01", "1997-06-30"), ("c", "1998-03-01", "2010-01-01")]
SEGMENTS_SQL = "segments(segment, start_date, end_date) AS (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in SEGMENTS) + ")"


@query(
    "segment_metrics",
    f"""WITH {DAILY_SQL}, {SEGMENTS_SQL},
per AS (SELECT segment, count(*) AS n, avg(ic) AS ic, avg(rank_ic) AS rank_ic FROM daily JOIN segments ON date BETWEEN start_date AND end_date GROUP BY 1)
SELECT {q6('sum(ic * n) / sum(n)')} AS ic, {q6('sum(rank_ic * n) / sum(n)')} AS rank_ic FROM per""",
)
def segment_metrics(spark, folder):
    s = spark.createDataFrame(SEGMENTS, "segment string, s string, e string")
    s = s.select("segment", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    out = M.segment_metrics(M.pool_daily(panel(spark, folder), POOL, FORWARD), s, ["ic", "rank_ic"])
    return out.select(r6("ic").alias("ic"), r6("rank_ic").alias("rank_ic"))


SCORES_SQL = f"{FACTORS_SQL}, per AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS expr, {pearson(f'za{i}', 'zy')} AS ic FROM z GROUP BY date" for i, f in enumerate(POOL)
) + "), scores AS (SELECT expr, avg(ic) AS ic FROM per GROUP BY 1)"


@query("candidate_scores", f"WITH {SCORES_SQL} SELECT expr, {q6('ic')} AS ic FROM scores")
def candidate_scores(spark, folder):
    return M.score_candidates(panel(spark, folder), list(POOL), FORWARD).select("expr", r6("ic").alias("ic"))


@query("top_candidates", f"WITH {SCORES_SQL} SELECT expr, {q6('ic')} AS ic FROM scores ORDER BY ic DESC, expr LIMIT 3")
def top_candidates(spark, folder):
    return M.top_candidates(M.score_candidates(panel(spark, folder), list(POOL), FORWARD), 3).select("expr", r6("ic").alias("ic"))


@query(
    "factor_rows",
    f"WITH {FACTORS_SQL} " + " UNION ALL ".join(f"SELECT symbol, date, '{f}' AS expr, {q6(f'a{i}')} AS value FROM factors" for i, f in enumerate(POOL)),
)
def factor_rows_query(spark, folder):
    return factor_rows(panel(spark, folder), list(POOL)).select("symbol", "date", "expr", r6("value").alias("value"))


# Top 10 % of the symbols, every third month.
TURNOVER_SQL = f"""{FACTORS_SQL},
n AS (SELECT greatest(1, least(count(DISTINCT symbol), CAST(round_even(count(DISTINCT symbol) * 0.1, 0) AS BIGINT))) AS k, max(date_idx) AS last FROM factors),
step AS (SELECT date_idx, symbol, row_number() OVER (PARTITION BY date_idx ORDER BY a0 DESC, symbol) AS r,
         count(*) OVER (PARTITION BY date_idx) AS valid FROM factors WHERE date_idx % 3 = 0 AND a0 IS NOT NULL),
sizes AS (SELECT DISTINCT a.date_idx, least(n.k, a.valid, b.valid) AS k FROM step a JOIN step b ON b.date_idx = a.date_idx + 3 CROSS JOIN n WHERE a.date_idx < n.last + 1 - 3),
samples AS (SELECT s.date_idx, 1.0 - count(b.symbol) / CAST(max(s.k) AS DOUBLE) AS turnover FROM sizes s
  JOIN step a ON a.date_idx = s.date_idx AND a.r <= s.k
  LEFT JOIN step b ON b.date_idx = s.date_idx + 3 AND b.symbol = a.symbol AND b.r <= s.k GROUP BY s.date_idx)"""


def turnover_input(spark, folder):
    p = add_factors(panel(spark, folder), {"a": ALPHA})
    return p.over(p.df.select("symbol", "date", "date_idx", "a"))


@query("turnover_samples", f"WITH {TURNOVER_SQL} SELECT date_idx, {q6('turnover')} AS turnover FROM samples")
def turnover_samples(spark, folder):
    return M.selection_turnover_samples(turnover_input(spark, folder), "a", 3).select("date_idx", r6("turnover").alias("turnover"))


@query("turnover_topk", f"WITH {TURNOVER_SQL} SELECT {q6('coalesce(avg(turnover), 0.0)')} AS turnover FROM samples")
def turnover_topk(spark, folder):
    return M.selection_turnover(turnover_input(spark, folder), "a", 3).select(r6("turnover").alias("turnover"))


@query(
    "composite_objective",
    f"""WITH {DAILY_SQL.replace(FACTORS_SQL, TURNOVER_SQL)}, o AS (SELECT avg(ic0) AS ic, CASE WHEN stddev_samp(ic0) < 1e-6 THEN 0.0 ELSE avg(ic0) / stddev_samp(ic0) END AS icir FROM daily),
t AS (SELECT coalesce(avg(turnover), 0.0) AS t FROM samples)
SELECT {q6('ic')} AS ic, {q6('icir')} AS icir, {q6('0.1 * t')} AS penalty, {q6('ic + icir - 0.1 * t')} AS objective FROM o, t""",
)
def composite_objective(spark, folder):
    a = alpha(spark, folder)
    out = M.objective(M.alpha_daily_ic(a, "a", "y"), M.selection_turnover(a, "a", 3), use_icir=True, penalty=0.1)
    return out.select(*[r6(c).alias(c) for c in ("ic", "icir", "penalty", "objective")])


# --- pools ---------------------------------------------------------------------------------------


@query(
    "pool_admission",
    f"""WITH {MUTUAL_SQL}, per AS ({' UNION ALL '.join(f"SELECT {i} AS k, {pearson(f'za{i}', 'zy')} AS ic FROM z GROUP BY date" for i in range(5))}),
s AS (SELECT k, avg(ic) AS ic FROM per GROUP BY 1), m AS (SELECT i, j, avg(ic) AS ic FROM mutual GROUP BY 1, 2)
SELECT CAST(k AS VARCHAR) AS expr, {q6('ic')} AS ic FROM s WHERE ic >= -0.02 AND k NOT IN (SELECT j FROM m WHERE ic > 0.3)""",
)
def pool_admission(spark, folder):
    p = pool_panel(spark, folder)
    cols = [f"a{i}" for i in range(5)]
    rows = p.df.select("date", "y", F.explode(F.array(*[F.struct(F.lit(str(i)).alias("expr"), F.col(c).alias("x")) for i, c in enumerate(cols)])).alias("_p")).select("date", "y", "_p.*")
    ics = M.normalised_ic(rows, F.col("x"), F.col("y"), ["expr", "date"]).groupBy("expr").agg(F.avg("ic").alias("ic"))
    pairs = M.mutual_ic_matrix(p, cols).filter("i < j").select(F.col("j").cast("string").alias("expr"), F.col("i").alias("member"), "ic")
    return K.admission_filter(ics, pairs, -0.02, 0.3).select("expr", r6("ic").alias("ic"))


# Candidates that resemble each other: prices of one bar move together.
CANDIDATES = {"$close": "close", "$high": "high", "$low": "low", "$open": "open", "$vwap": "vwap", "Sub($high,$low)": "high - low", "Add($high,$low)": "high + low", "$volume": "volume", "Mul($volume,$vwap)": "volume * vwap", "Sub($close,$open)": "close - open", "Sub($vwap,$open)": "vwap - open"}
_N = len(CANDIDATES)
GREEDY_SQL = f"""{PANEL_SQL},
f AS (SELECT symbol, date, {", ".join(f"{c} AS a{i}" for i, c in enumerate(CANDIDATES.values()))}, lead(close, 1) OVER s / nullif(close, 0) - 1.0 AS y
  FROM panel {window_sql()}),
z AS (SELECT date, {", ".join(f"coalesce(({c} - avg({c}) OVER d) / nullif(stddev_pop({c}) OVER d, 0), 0) AS z{c}" for c in (*(f"a{i}" for i in range(_N)), "y"))}
  FROM f WINDOW d AS (PARTITION BY date)),
per AS (SELECT date, {", ".join(f"{pearson(f'za{i}', f'za{j}')} AS m{i}_{j}" for i in range(_N) for j in range(_N))}, {", ".join(f"{pearson(f'za{i}', 'zy')} AS c{i}" for i in range(_N))}
  FROM z GROUP BY date),
m AS (SELECT [{", ".join("[" + ", ".join(f"avg(m{i}_{j})" for j in range(_N)) + "]" for i in range(_N))}] AS m, [{", ".join(f"avg(c{i})" for i in range(_N))}] AS c FROM per),
o AS (SELECT row_number() OVER (ORDER BY c[k] DESC, expr) AS pos, k, expr, c[k] AS ic FROM m, (VALUES {", ".join(f"({i + 1}, '{e}')" for i, e in enumerate(CANDIDATES))}) t(k, expr)),
walk(pos, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[])
  UNION ALL
  SELECT o.pos, CASE WHEN len(kept) < 4 AND len([x FOR x IN kept IF abs(m.m[o.k][x]) > 0.7]) = 0 THEN list_append(kept, o.k) ELSE kept END
  FROM walk JOIN o ON o.pos = walk.pos + 1, m)"""


@query(
    "pool_selection",
    f"""WITH RECURSIVE {GREEDY_SQL}
SELECT CAST(list_position(kept, k) - 1 AS INTEGER) AS rank, expr, {q6('ic')} AS ic FROM walk JOIN o ON list_contains(kept, o.k) WHERE walk.pos = {_N}""",
)
def pool_selection(spark, folder):
    """Four of eleven formulas, none of them close to a better one."""
    out = K.select_decorrelated(panel(spark, folder), list(CANDIDATES), FORWARD, 0.7, 4)
    return out.select("rank", "expr", r6("ic").alias("ic"))


FIT_SQL = f"""{MUTUAL_SQL},
per AS ({' UNION ALL '.join(f"SELECT {i} AS k, {pearson(f'za{i}', 'zy')} AS ic FROM z GROUP BY date" for i in range(5))}),
mm AS (SELECT [{", ".join("[" + ", ".join("1.0" if i == j else f"avg(ic) FILTER (i = {min(i, j)} AND j = {max(i, j)})" for j in range(5)) + "]" for i in range(5))}] AS m FROM mutual),
rr AS (SELECT list(ic ORDER BY k) AS r FROM (SELECT k, avg(ic) AS ic FROM per GROUP BY 1))"""


def fit_sql(k: int, alpha: float = 1e-3, sweeps: int = 60) -> str:
    """CTEs up to ``fit<k>`` (w): weights of the first k formulas, by coordinate descent from 0."""
    pull = f"(r[i] - list_sum([m[i][x] * w[x] FOR x IN range(1, {k + 1})]) + w[i])"
    return f"""descent{k}(step, w) AS (
  SELECT 0, CAST([{", ".join(["0"] * k)}] AS DOUBLE[])
  UNION ALL
  SELECT step + 1, [CASE WHEN x <> i THEN w[x] ELSE sign({pull}) * greatest(abs({pull}) - {alpha / 2}, 0) END FOR x IN range(1, {k + 1})]
  FROM (SELECT step, w, m, r, step % {k} + 1 AS i FROM descent{k}, mm, rr WHERE step < {k * sweeps}) t),
fit{k} AS (SELECT w FROM descent{k} ORDER BY step DESC LIMIT 1)"""


NAMES_SQL = "names(k, expr) AS (VALUES " + ", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(POOL)) + ")"


@query(
    "pool_fit",
    f"""WITH RECURSIVE {FIT_SQL}, {fit_sql(4)}, {fit_sql(5)}, {NAMES_SQL},
e AS (SELECT k, expr, fit4.w[k] AS before, fit5.w[k] AS after, r[k] AS ic, row_number() OVER (ORDER BY abs(fit5.w[k]), k) AS place FROM fit4, fit5, rr, names),
f AS (SELECT *, max(CASE WHEN place = 1 THEN k END) OVER () = 5 AS newest FROM e)
SELECT 'pool' AS pool_id, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS idx, expr, {q6('CASE WHEN newest THEN before ELSE after END')} AS weight, {q6('ic')} AS ic
FROM f WHERE place > 1""",
)
def pool_fit(spark, folder):
    """Five formulas offered to a pool of four: the smallest weight leaves; if that is the fifth, the four stay as they were."""
    out = K.extend_pool(panel(spark, folder), K.Pool(4), list(POOL), FORWARD, alpha=1e-3).to_rows(spark)
    return out.select("pool_id", "idx", "expr", r6("weight").alias("weight"), r6("ic").alias("ic"))


@query(
    "pool_force_load",
    f"""WITH {SCORES_SQL}, w(idx, expr, weight) AS (VALUES {', '.join(f"({i}, '{f}', CAST({w} AS DOUBLE))" for i, (f, w) in enumerate(POOL.items()))})
SELECT 'pool' AS pool_id, idx, expr, {q6('weight')} AS weight, {q6('ic')} AS ic FROM w JOIN scores USING (expr)""",
)
def pool_force_load(spark, folder):
    out = K.force_load(panel(spark, folder), list(POOL), FORWARD, weights=list(POOL.values())).to_rows(spark)
    return out.select("pool_id", "idx", "expr", r6("weight").alias("weight"), r6("ic").alias("ic"))


@query("pool_fit_icir")
def pool_fit_icir(spark, folder):
    stats = K.pool_statistics(panel(spark, folder), list(POOL), FORWARD, keep_daily=True)
    w = K.fit_weights_daily(stats, alpha=1e-3)
    return K.Pool(5, stats.exprs, w, stats.ics, stats.mutual).to_rows(spark)


@query(
    "pool_merge",
    f"""WITH RECURSIVE {FIT_SQL}, {fit_sql(4)}, {NAMES_SQL}
SELECT 'pool' AS pool_id, k - 1 AS idx, expr, {q6('0.9 * w[k]')} AS weight, {q6('r[k]')} AS ic FROM fit4, rr, names WHERE k <= 4""",
)
def pool_merge(spark, folder):
    names = list(POOL)
    pools = {"12m": {n: POOL[n] for n in names[:3]}, "6m": {n: POOL[n] for n in names[1:4]}, "3m": {n: POOL[n] for n in names[2:]}}
    out = K.merge_pools(panel(spark, folder), pools, FORWARD, 4, alpha=1e-3, shrink=0.9).to_rows(spark)
    return out.select("pool_id", "idx", "expr", r6("weight").alias("weight"), r6("ic").alias("ic"))


# --- walk-forward --------------------------------------------------------------------------------

WINDOWS_SQL = """steps AS (SELECT k, CAST(DATE '1996-01-01' + to_months(CAST(k * 3 AS INTEGER)) AS DATE) AS ds FROM range(200) t(k)),
windows AS (SELECT CAST(k AS INTEGER) AS window_idx, greatest(CAST(ds - INTERVAL 12 MONTH AS DATE), DATE '1995-06-01') AS train_start,
  CAST(ds - INTERVAL 1 DAY AS DATE) AS train_end, ds AS deploy_start, least(CAST(ds + INTERVAL 2 MONTH AS DATE), DATE '2001-03-15') AS deploy_end,
  strftime(ds, '%Y_%m') AS deploy_month FROM steps
  WHERE ds < DATE '2001-03-15' AND (k = 0 OR CAST(ds - INTERVAL 1 MONTH AS DATE) < DATE '2001-03-15'))"""


def rolling(spark):
    return T.rolling_windows(spark, "1995-06-01", "1996-01-01", "2001-03-15", 12, 2, 3)


@query(
    "walk_forward",
    f"""WITH {DAILY_SQL}, {WINDOWS_SQL} SELECT window_idx, deploy_month, {q6('avg(ic) FILTER (date BETWEEN train_start AND train_end)')} AS train_ic,
{q6('avg(ic) FILTER (date BETWEEN deploy_start AND deploy_end)')} AS deploy_ic, {q6('avg(rank_ic) FILTER (date BETWEEN deploy_start AND deploy_end)')} AS deploy_rank_ic
FROM windows LEFT JOIN daily ON date BETWEEN train_start AND deploy_end GROUP BY 1, 2""",
)
def walk_forward(spark, folder):
    out = T.walk_forward(panel(spark, folder), POOL, FORWARD, rolling(spark))
    return out.select("window_idx", "deploy_month", *[r6(c).alias(c) for c in ("train_ic", "deploy_ic", "deploy_rank_ic")])


@query(
    "window_panel",
    f"""WITH {PANEL_SQL}, {WINDOWS_SQL} SELECT window_idx, count(*) AS row_count, count(close) AS closes, {q6('avg(close)')} AS mean_close
FROM panel JOIN windows ON date BETWEEN train_start AND train_end GROUP BY 1""",
)
def window_panel(spark, folder):
    rows = T.in_windows(panel(spark, folder).df, rolling(spark), "train_start", "train_end", "window_idx")
    return rows.groupBy("window_idx").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("close").alias("closes"), r6(F.avg("close")).alias("mean_close")
    )


@query(
    "rolling_windows",
    f"""WITH {WINDOWS_SQL}, m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem)
SELECT w.*, (SELECT count(*) FROM m WHERE date BETWEEN train_start AND train_end) AS train_dates FROM windows w""",
)
def rolling_windows(spark, folder):
    m = table(spark, folder, "lineitem").select(F.trunc("l_shipdate", "month").alias("date")).distinct()
    w = rolling(spark)
    counts = T.in_windows(m, w, "train_start", "train_end", "window_idx").groupBy("window_idx").agg(F.count(F.lit(1)).alias("train_dates"))
    return w.join(counts, "window_idx", "left").withColumn("train_dates", F.coalesce("train_dates", F.lit(0)))


@query(
    "horizon_windows",
    f"""WITH {DAILY_SQL}, last AS (SELECT CAST(max(date) AS DATE) AS e FROM panel),
w AS (SELECT m || 'm' AS win, CAST(e - INTERVAL 3 MONTH - to_months(CAST(m AS INTEGER)) AS DATE) AS s, CAST(e - INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS t FROM last, (VALUES (12), (6), (3)) v(m)
UNION ALL SELECT 'validation', CAST(e - INTERVAL 3 MONTH AS DATE), e FROM last)
SELECT win AS "window", {q6('avg(ic)')} AS ic, count(*) AS dates FROM daily JOIN w ON date BETWEEN s AND t GROUP BY 1""",
)
def horizon_windows(spark, folder):
    p = panel(spark, folder)
    last = p.df.agg(F.max("date")).first()[0]
    daily = M.pool_daily(p, POOL, FORWARD)
    out = T.in_windows(daily, T.horizon_windows(spark, str(last)))
    return out.groupBy("window").agg(r6(F.avg("ic")).alias("ic"), F.count(F.lit(1)).alias("dates"))


@query(
    "train_test_split",
    f"""WITH {PANEL_SQL} SELECT symbol, date, date > (SELECT CAST(max(date) - INTERVAL 12 MONTH AS DATE) FROM panel) AS is_test FROM panel""",
)
def train_test_split(spark, folder):
    return T.train_test_split(panel(spark, folder).df, 12).select("symbol", "date", "is_test")
