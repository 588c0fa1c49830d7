"""Scores, screens, weights, swaps, returns and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import pool as K
from ..operators import portfolio as G
from ..operators import quality as V
from ..operators.metrics import score_candidates
from ..plans.evaluate import add_factors
from ..plans.formula import FormulaOptions
from ..sources import store as S
from .bars import SLOW_SQL, daily, rounded, slow
from .bars import DAILY_SQL as DAILY_BARS_SQL
from .base import q6, query, r6, table
from .fixtures import BARS_SQL, FORWARD, PANEL_SQL, bars, panel

WEIGHTS = {"close": 0.6, "volume": -0.3, "vwap": 0.25}
DAY = "OVER (PARTITION BY date)"


def guarded(c, n=2):
    return f"coalesce(CASE WHEN count({c}) {DAY} >= {n} AND stddev_pop({c}) {DAY} >= 1e-8 THEN ({c} - avg({c}) {DAY}) / stddev_pop({c}) {DAY} END, 0)"


PRESENT = " OR ".join(f"{c} IS NOT NULL" for c in WEIGHTS)
SCORED = f"CASE WHEN {PRESENT} THEN {' + '.join(f'{w} * {guarded(c)}' for c, w in WEIGHTS.items())} END AS score"
SCORE_SQL = f"{PANEL_SQL}, s AS (SELECT symbol, date, date_idx, close, volume, {SCORED} FROM panel)"


def scored(spark, folder):
    p = panel(spark, folder)
    p = p.over(p.df.select("symbol", "date", "date_idx", "close", F.col("volume").alias("vol_raw"), "volume", "vwap", F.col("close").alias("price")))
    return G.factor_score(p, WEIGHTS)


@query("factor_score", f"WITH {SCORE_SQL} SELECT symbol, date, {q6('score')} AS score FROM s")
def factor_score(spark, folder):
    return rounded(scored(spark, folder).df, "symbol", "date", cols=("score",))


# Users trade on some days only: names come and go, and those absent on a day have no score and no place in a portfolio.
USERS_SQL = f"""{DAILY_BARS_SQL}, users AS (SELECT s.symbol, c.date, c.date_idx, d.close, d.volume, d.vwap
  FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM daily)) c
  CROSS JOIN (SELECT DISTINCT symbol FROM daily) s LEFT JOIN daily d ON d.symbol = s.symbol AND d.date = c.date)"""
USERS_RANKED_SQL = f"""{USERS_SQL}, s AS (SELECT symbol, date, {SCORED} FROM users),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank, count(*) {DAY} AS n FROM s WHERE score IS NOT NULL)"""


def users_scored(spark, folder):
    p = P.densify(daily(spark, folder).select("symbol", "date", "close", "volume", "vwap"))
    return G.factor_score(p, WEIGHTS)


@query("factor_score_sparse", f"WITH {USERS_SQL} SELECT symbol, date, {q6('score')} AS score FROM (SELECT symbol, date, {SCORED} FROM users)")
def factor_score_sparse(spark, folder):
    return rounded(users_scored(spark, folder).df, "symbol", "date", cols=("score",))


@query("long_only_sparse", f"WITH {USERS_RANKED_SQL} SELECT date, symbol, rank, {q6('least(1.0 / least(20, greatest(floor(n * 0.15), 1)), 0.15)')} AS weight FROM ranked WHERE rank <= least(20, greatest(floor(n * 0.15), 1))")
def long_only_sparse(spark, folder):
    out = G.long_only(users_scored(spark, folder), "score", 0.15)
    return out.select("date", "symbol", F.col("rank").cast("long").alias("rank"), r6("weight").alias("weight"))


@query(
    "long_short_sparse",
    f"""WITH {USERS_RANKED_SQL}, k AS (SELECT *, least(floor(n * 0.08), 10) AS k FROM ranked)
SELECT date, symbol, {q6("CASE WHEN rank > n - k THEN -least(0.5 / k, 0.15) ELSE least(0.5 / k, 0.15) END")} AS weight FROM k WHERE k > 0 AND (rank > n - k OR rank <= k)""",
)
def long_short_sparse(spark, folder):
    return G.long_short(users_scored(spark, folder), "score", 0.08).select("date", "symbol", r6("weight").alias("weight"))


@query("raw_score", f"WITH {PANEL_SQL} SELECT symbol, date, {q6('0.6 * close - 0.3 * volume + 0.25 * vwap')} AS score FROM panel")
def raw_score(spark, folder):
    return rounded(G.raw_score(panel(spark, folder), WEIGHTS).df, "symbol", "date", cols=("score",))


@query(
    "proxy_score",
    f"""WITH {DAILY_BARS_SQL}, {SLOW_SQL}, j AS (SELECT d.symbol, d.date, s.pe_ratio, d.close / 10.0 AS pb_ratio FROM daily d LEFT JOIN slow s USING (symbol, date)),
f AS (SELECT symbol, date, -0.3 * coalesce(pe_ratio, median(pe_ratio) {DAY}) - 0.3 * coalesce(pb_ratio, median(pb_ratio) {DAY}) AS x FROM j),
z AS (SELECT symbol, date, (x - avg(x) {DAY}) / nullif(stddev_samp(x) {DAY}, 0) AS z FROM f)
SELECT symbol, date, {q6('z')} AS score, {q6('z * 0.02')} AS predicted_return FROM z""",
)
def proxy_score(spark, folder):
    d = daily(spark, folder).select("symbol", "date", (F.col("close") / 10.0).alias("pb_ratio"))
    _, n_dates, widest = P.measure(table(spark, folder, "events"), F.to_date("ts"), F.col("user_id"))
    p = P.Panel(d.join(slow(spark, folder), ["symbol", "date"], "left"), n_dates, widest)
    return rounded(G.proxy_score(p).df, "symbol", "date", cols=("score", "predicted_return"))


RANKED_SQL = f"{SCORE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank, count(*) {DAY} AS n FROM s WHERE score IS NOT NULL)"


@query("top_k", f"WITH {BARS_SQL}, r AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS rank FROM bars) SELECT symbol, date, rank FROM r WHERE rank <= 7")
def top_k(spark, folder):
    p = panel(spark, folder)
    return G.top_k(p.df.select("symbol", "date", "close"), "close", 7).select("symbol", "date", F.col("rank").cast("long").alias("rank"))


@query("latest_top_k", f"WITH {BARS_SQL} SELECT symbol, {q6('close')} AS close, row_number() OVER (ORDER BY close DESC, symbol) AS rank FROM bars WHERE date = (SELECT max(date) FROM bars) ORDER BY close DESC, symbol LIMIT 10")
def latest_top_k(spark, folder):
    out = G.latest_top_k(bars(spark, folder), "close", 10)
    return out.select("symbol", r6("close").alias("close"), F.col("rank").cast("long").alias("rank"))


@query("liquid_universe", f"WITH {BARS_SQL} SELECT symbol, date FROM bars WHERE low >= 5.0 AND volume * low >= 300.0")
def liquid_universe(spark, folder):
    return G.liquid(bars(spark, folder), "low", "volume", 5.0, 300.0).select("symbol", "date")


@query("screen_counts", f"WITH {BARS_SQL} SELECT date, CASE WHEN low < 5.0 THEN 'price' WHEN volume * 30000.0 * low < 1000000.0 THEN 'volume' ELSE 'passed' END AS reason, count(*) AS n FROM bars GROUP BY 1, 2")
def screen_counts(spark, folder):
    return G.screen_counts(bars(spark, folder).withColumn("volume", F.col("volume") * 30000.0), "low")


LONG_SQL = f"{RANKED_SQL}, longs AS (SELECT date, date_idx, symbol, rank, least(1.0 / least(20, greatest(floor(n * 0.15), 1)), 0.15) AS weight FROM ranked WHERE rank <= least(20, greatest(floor(n * 0.15), 1)))"


def longs(spark, folder):
    s = scored(spark, folder)
    return s, G.long_only(s, "score", 0.15)


@query("long_only", f"WITH {LONG_SQL} SELECT date, symbol, rank, {q6('weight')} AS weight FROM longs")
def long_only(spark, folder):
    return longs(spark, folder)[1].select("date", "symbol", F.col("rank").cast("long").alias("rank"), r6("weight").alias("weight"))


@query(
    "long_short",
    f"""WITH {RANKED_SQL}, k AS (SELECT *, least(floor(n * 0.08), 10) AS k FROM ranked)
SELECT date, symbol, {q6("CASE WHEN rank > n - k THEN -least(0.5 / k, 0.15) ELSE least(0.5 / k, 0.15) END")} AS weight FROM k WHERE k > 0 AND (rank > n - k OR rank <= k)""",
)
def long_short(spark, folder):
    return G.long_short(scored(spark, folder), "score", 0.08).select("date", "symbol", r6("weight").alias("weight"))


@query("rebalance_dates", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(min(o_orderdate) AS DATE) AS date FROM orders GROUP BY 1")
def rebalance_dates(spark, folder):
    return G.rebalance_dates(table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")))


# Every fifth month has a set; of those every other one is broken (two formulas, one weight).
SETS_SQL = """months AS (SELECT date AS month, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem)),
sets AS (SELECT month AS from_month, k FROM months WHERE k % 5 = 2 AND k % 10 <> 7)"""


@query("factor_sets_as_of", f"WITH {SETS_SQL} SELECT m.month, s.from_month, CASE WHEN s.from_month IS NULL THEN NULL ELSE 'f' || s.k END AS first_expr, 0.5 * s.k AS first_weight FROM months m ASOF LEFT JOIN sets s ON m.month >= s.from_month")
def factor_sets_as_of(spark, folder):
    months = P.calendar(table(spark, folder, "lineitem").select(F.trunc("l_shipdate", "month").alias("date"))).withColumnRenamed("date", "month")
    k = F.col("date_idx")
    name = F.concat(F.lit("f"), k.cast("string"))
    broken = k % 10 == 7
    sets = months.filter(k % 5 == 2).select("month", F.when(broken, F.array(name, name)).otherwise(F.array(name)).alias("exprs"), F.array(k * 0.5).alias("weights"))
    out = G.factor_sets_as_of(months, sets)
    return out.select("month", "from_month", F.get("exprs", F.lit(0)).alias("first_expr"), F.get("weights", F.lit(0)).alias("first_weight"))


MOVES_SQL = f"""{LONG_SQL}, moves AS (SELECT date_idx, symbol, sum(w) AS weight, sum(d) AS change FROM
  (SELECT date_idx, symbol, weight AS w, weight AS d FROM longs UNION ALL SELECT date_idx + 1, symbol, 0.0, -weight FROM longs) GROUP BY 1, 2)"""


@query("portfolio_diff", f"WITH {MOVES_SQL} SELECT date_idx, symbol, {q6('weight')} AS weight, {q6('change')} AS change, CASE WHEN weight = 0 THEN 'sell' ELSE 'set' END AS action FROM moves WHERE date_idx IN (SELECT date_idx FROM longs)")
def portfolio_diff(spark, folder):
    out = G.portfolio_diff(longs(spark, folder)[1])
    return out.select("date_idx", "symbol", r6("weight").alias("weight"), r6("change").alias("change"), "action")


RETURNS_SQL = f"""{MOVES_SQL}, fwd AS (SELECT symbol, date_idx, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date_idx) / nullif(close, 0) - 1.0 AS ret FROM panel),
gross AS (SELECT date_idx, sum(weight * ret) AS gross FROM longs JOIN fwd USING (symbol, date_idx) GROUP BY 1),
cost AS (SELECT date_idx, sum(abs(change)) * 0.0015 AS cost FROM moves GROUP BY 1),
rets AS (SELECT date_idx, gross, cost, gross - cost AS net FROM gross JOIN cost USING (date_idx))"""


def net_returns(spark, folder):

    w = longs(spark, folder)[1]
    r = add_factors(panel(spark, folder), {"ret": FORWARD}).df.select("symbol", "date_idx", "ret")
    return G.portfolio_returns(w, r)


@query("portfolio_returns", f"WITH {RETURNS_SQL} SELECT date_idx, {q6('gross')} AS gross, {q6('cost')} AS cost, {q6('net')} AS net FROM rets")
def portfolio_returns(spark, folder):
    return rounded(net_returns(spark, folder), "date_idx", cols=("gross", "cost", "net"))


@query(
    "risk_summary",
    f"""WITH {RETURNS_SQL}, c AS (SELECT *, net - cost * 2 AS ex, sum(net) OVER o AS cum, sum(net - cost * 2) OVER o AS excum FROM rets WINDOW o AS (ORDER BY date_idx)),
d AS (SELECT *, cum - greatest(max(cum) OVER o, 0) AS dd, excum - greatest(max(excum) OVER o, 0) AS exdd FROM c WINDOW o AS (ORDER BY date_idx))
SELECT {q6('avg(net) * 12')} AS annual_return, {q6('avg(net) / stddev_samp(net) * sqrt(12)')} AS sharpe, {q6('min(dd)')} AS max_drawdown,
{q6('avg(ex) * 12')} AS excess_annual_return, {q6('avg(ex) / stddev_samp(ex) * sqrt(12)')} AS excess_sharpe, {q6('min(exdd)')} AS excess_max_drawdown FROM d""",
)
def risk_summary(spark, folder):
    r = net_returns(spark, folder).withColumn("bench", F.col("cost") * 2)
    out = G.risk_summary(r, periods=12.0, benchmark="bench")
    return out.select(*[r6(c).alias(c) for c in out.columns])


STATUS_SQL = f"""{PANEL_SQL}, status AS (SELECT symbol, date, date_idx, symbol % 7 <> 0 AS buyable, symbol % 5 <> 0 AS sellable, close AS signal,
  CASE WHEN symbol % 10 = date_idx % 10 THEN symbol % 4 END AS days_holded FROM panel),
cand AS (SELECT date, symbol, signal, row_number() OVER (PARTITION BY date ORDER BY signal DESC, symbol) AS r FROM status WHERE signal IS NOT NULL AND days_holded IS NULL AND buyable),
hold AS (SELECT date, symbol, signal, row_number() OVER (PARTITION BY date ORDER BY signal, symbol DESC) AS r FROM status WHERE signal IS NOT NULL AND days_holded >= 1 AND sellable),
pairs AS (SELECT c.date, c.symbol, h.symbol AS out FROM cand c JOIN hold h ON c.date = h.date AND c.r = h.r AND c.r <= 3 AND c.signal > h.signal),
room AS (SELECT s.date, greatest(12 - count(days_holded), 0) AS free, (SELECT count(*) FROM pairs p WHERE p.date = s.date) AS swaps FROM status s GROUP BY 1)"""


@query(
    "swap_decision",
    f"""WITH {STATUS_SQL} SELECT date, symbol, 'swap_in' AS action FROM pairs UNION ALL SELECT date, out, 'swap_out' FROM pairs
UNION ALL SELECT c.date, c.symbol, 'open' FROM cand c JOIN room USING (date) WHERE c.r > swaps AND c.r <= swaps + free""",
)
def swap_decision(spark, folder):
    p = panel(spark, folder)
    s = F.col("symbol")
    status = p.df.select(
        "symbol", "date", (s % 7 != 0).alias("buyable"), (s % 5 != 0).alias("sellable"), F.col("close").alias("signal"),
        F.when(s % 10 == F.col("date_idx") % 10, s % 4).alias("days_holded"),
    )
    return G.swap_decision(status, 12, 3).select("date", "symbol", "action")


@query("cash_allocation", f"WITH {LONG_SQL} SELECT l.date, l.symbol, {q6('95000.0 / count(*) OVER (PARTITION BY l.date)')} AS value, {q6('95000.0 / count(*) OVER (PARTITION BY l.date) / nullif(s.close, 0)')} AS amount FROM longs l JOIN s ON l.date = s.date AND l.symbol = s.symbol")
def cash_allocation(spark, folder):
    s, w = longs(spark, folder)
    buys = w.join(s.df.select("date", "symbol", "price"), ["date", "symbol"])
    return rounded(G.cash_allocation(buys, 100000.0), "date", "symbol", cols=("value", "amount"))


@query("score_summary", f"WITH {SCORE_SQL} SELECT count(score) AS count, {q6('min(score)')} AS min, {q6('max(score)')} AS max, {q6('avg(score)')} AS mean, " + ", ".join(f"{q6(f'quantile_cont(score, {p / 100})')} AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM s")
def score_summary(spark, folder):
    out = G.score_summary(scored(spark, folder).df, "score", ["symbol", "date"])
    return out.select("count", *[r6(c).alias(c) for c in out.columns if c != "count"])


@query("weight_summary", f"WITH {LONG_SQL} SELECT count(*) AS non_zero, {q6('sum(weight)')} AS l1 FROM longs")
def weight_summary(spark, folder):
    return G.weight_summary(longs(spark, folder)[1]).select("non_zero", r6("l1").alias("l1"))


# --- pool tables ---------------------------------------------------------------------------------

# One pool per hundred parts, so pools keep their size as the table grows; price differences are the weights.
MEMBERS_SQL = "members AS (SELECT p_partkey // 100 AS pool_id, CAST(p_partkey AS INTEGER) AS idx, p_name || p_partkey AS expr, (p_retailprice - 950.0) / 100.0 AS weight FROM part)"


def members(spark, folder):
    p = table(spark, folder, "part")
    return p.select(
        F.floor(F.col("p_partkey") / 100).alias("pool_id"), F.col("p_partkey").cast("int").alias("idx"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("expr"),
        ((F.col("p_retailprice") - 950.0) / 100.0).alias("weight"),
    )


@query("significant_members", f"WITH {MEMBERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY abs(weight) DESC, idx) AS rank FROM members) SELECT pool_id, idx, rank FROM r WHERE rank <= 5")
def significant_members(spark, folder):
    out = K.significant_members(members(spark, folder), 5)
    return out.select("pool_id", "idx", F.col("rank").cast("long").alias("rank"))


@query("shrunken_weights", f"WITH {MEMBERS_SQL} SELECT pool_id, idx, {q6('weight * 0.9')} AS weight FROM members")
def shrunken_weights(spark, folder):
    return K.shrink_weights(members(spark, folder)).select("pool_id", "idx", r6("weight").alias("weight"))


@query("weight_norms", f"WITH {MEMBERS_SQL} SELECT {q6('sum(abs(weight))')} AS l1_before, {q6('sum(abs(weight)) * 0.9')} AS l1_after FROM members")
def weight_norms(spark, folder):
    out = K.weight_norms(members(spark, folder))
    return out.select(r6("l1_before").alias("l1_before"), r6("l1_after").alias("l1_after"))


@query("pool_round_trip", f"WITH {MEMBERS_SQL} SELECT pool_id, row_number() OVER (PARTITION BY pool_id ORDER BY idx) - 1 AS idx, expr, {q6('weight')} AS weight FROM members")
def pool_round_trip(spark, folder):
    packed = S.pack_pools(members(spark, folder))
    out = S.explode_pool(packed, "pool_id")
    return out.select("pool_id", F.col("idx").cast("long").alias("idx"), "expr", r6("weight").alias("weight"))


@query("artifact_manifest", "SELECT count(*) AS n_windows, string_agg(m || '.json', ',' ORDER BY m) AS files FROM (SELECT DISTINCT strftime(l_shipdate, '%Y_%m') AS m FROM lineitem)")
def artifact_manifest(spark, folder):
    w = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy_MM").alias("deploy_month")).distinct()
    return S.manifest(w).select("n_windows", F.array_join("files", ",").alias("files"))


@query(
    "window_contributions",
    """WITH c AS (SELECT p_type AS win, p_name AS expr, count(*) AS n FROM part GROUP BY 1, 2), f AS (SELECT DISTINCT p_name AS expr FROM part WHERE p_size > 45)
SELECT win AS "window", CAST(sum(n) AS BIGINT) AS total_factors, count(f.expr) AS in_final, round(count(f.expr) * 100.0 / sum(n) + 3.3e-08, 6) + 0.0 AS percentage FROM c LEFT JOIN f ON c.expr = f.expr GROUP BY 1""",
)
def window_contributions(spark, folder):
    p = table(spark, folder, "part")
    collected = p.select(F.col("p_type").alias("window"), F.col("p_name").alias("expr"))
    out = K.window_contributions(collected, p.filter("p_size > 45").select(F.col("p_name").alias("expr")))
    return out.withColumn("percentage", r6("percentage"))


@query("pool_diagnostics", "WITH l AS (SELECT CASE WHEN p_size < 10 THEN 'ic below bound' WHEN p_size < 20 THEN 'mutual ic above limit' ELSE 'admitted' END AS reason FROM part) SELECT reason, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM l) + 3.3e-08, 6) + 0.0 AS percentage FROM l GROUP BY 1")
def pool_diagnostics(spark, folder):
    log = table(spark, folder, "part").select(F.when(F.col("p_size") < 10, "ic below bound").when(F.col("p_size") < 20, "mutual ic above limit").alias("failure"))
    return K.pool_diagnostics(log).withColumn("percentage", r6("percentage"))


@query("objective_summary", f"SELECT {q6('min(p_retailprice)')} AS min, {q6('max(p_retailprice)')} AS max, {q6('avg(p_retailprice)')} AS mean, count(p_retailprice) AS count FROM part")
def objective_summary(spark, folder):
    out = K.objective_summary(table(spark, folder, "part"), "p_retailprice")
    return out.select("count", *[r6(c).alias(c) for c in ("min", "max", "mean")])


@query("last_objectives", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_partkey DESC LIMIT 10")
def last_objectives(spark, folder):
    return K.last_objectives(table(spark, folder, "part").select("p_partkey", "p_retailprice"), 10, "p_partkey")


@query("error_statistics", "SELECT p_type AS error_type, p_brand AS error_node, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1, 2")
def error_statistics(spark, folder):
    p = table(spark, folder, "part").select((F.col("p_size") % 3 == 0).alias("invalid"), F.col("p_type").alias("error_type"), F.col("p_brand").alias("error_node"))
    return K.error_statistics(p)


@query("run_log", f"SELECT p_brand AS generation, {q6('avg(p_retailprice)')} AS mean_fitness, {q6('max(p_retailprice)')} AS best_fitness, {q6('avg(p_size)')} AS mean_length, max_by(p_size, p_retailprice * 1000 - p_size) AS best_length FROM part GROUP BY 1")
def run_log(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_brand").alias("generation"), F.col("p_retailprice").alias("fitness"), F.col("p_size").alias("length"))
    out = K.run_log(p)
    return out.select("generation", "best_length", *[r6(c).alias(c) for c in ("mean_fitness", "best_fitness", "mean_length")])


@query("success_rate", f"SELECT {q6('avg(CASE WHEN p_size > 30 THEN 1.0 ELSE 0.0 END)')} AS success_rate, count(*) AS runs FROM part")
def success_rate(spark, folder):
    out = K.success_rate(table(spark, folder, "part").select((F.col("p_size") > 30).alias("success")))
    return out.select(r6("success_rate").alias("success_rate"), "runs")


# --- data quality --------------------------------------------------------------------------------

FEATURES = ["open", "close", "volume", "vwap"]


@query("missing_by_feature", f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS total, round((count(*) - count({c})) * 100.0 / count(*) + 3.3e-08, 6) + 0.0 AS percentage FROM panel" for c in FEATURES))
def missing_by_feature(spark, folder):
    return V.missing_by_feature(panel(spark, folder).df, FEATURES).withColumn("percentage", r6("percentage"))


@query("finite_coverage", f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {q6(f'count({c}) / CAST(count(*) AS DOUBLE)')} AS coverage FROM panel" for c in FEATURES))
def finite_coverage(spark, folder):
    return V.finite_coverage(panel(spark, folder).df, FEATURES).withColumn("coverage", r6("coverage"))


MERGED_SQL = f"{DAILY_BARS_SQL}, {SLOW_SQL}, merged AS (SELECT d.*, CASE WHEN d.symbol % 3 <> 0 THEN s.pe_ratio END AS pe_ratio FROM daily d LEFT JOIN slow s USING (symbol, date))"


def merged(spark, folder):
    d = daily(spark, folder).join(slow(spark, folder), ["symbol", "date"], "left")
    return d.withColumn("pe_ratio", F.when(F.col("symbol") % 3 != 0, F.col("pe_ratio")))


@query("completeness_by_symbol", f"WITH {MERGED_SQL} SELECT symbol, count(*) AS days, bool_or(close IS NULL OR open IS NULL) AS price_missing, bool_or(volume IS NULL) AS volume_missing, count(pe_ratio) = 0 AS fundamentals_missing, max(date) AS last_date FROM merged GROUP BY 1")
def completeness_by_symbol(spark, folder):
    return V.completeness_by_symbol(merged(spark, folder), ["open", "close"], "volume", ["pe_ratio"])


@query("dataset_summary", f"WITH {DAILY_BARS_SQL} SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS days FROM daily")
def dataset_summary(spark, folder):
    return V.dataset_summary(daily(spark, folder))


VALID_SQL = f"""{MERGED_SQL}, names AS (SELECT DISTINCT s_suppkey AS symbol FROM supplier),
upto AS (SELECT * FROM merged WHERE date <= DATE '2024-01-25'),
latest AS (SELECT symbol, bool_and(pe_ratio IS NULL) FILTER (date = (SELECT max(date) FROM upto)) AS no_pe,
  bool_and(close IS NULL) FILTER (date = (SELECT max(date) FROM upto)) AS no_close, count(*) AS history FROM upto GROUP BY 1),
v AS (SELECT n.symbol, coalesce(history, 0) AS history, concat_ws(',', CASE WHEN coalesce(no_close, true) THEN 'close' END, CASE WHEN coalesce(no_pe, true) THEN 'pe_ratio' END) AS missing FROM names n LEFT JOIN latest USING (symbol))"""


def validated(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return V.validate_portfolio(names, merged(spark, folder), ["close", "pe_ratio"], "2024-01-25")


@query("validate_portfolio", f"WITH {VALID_SQL} SELECT symbol, history, missing, history >= 10 AS history_10, history >= 20 AS history_20, history >= 40 AS history_40, missing = '' AS complete FROM v")
def validate_portfolio(spark, folder):
    return validated(spark, folder)


@query("complete_share", f"WITH {VALID_SQL} SELECT count(*) AS names, {q6('avg(CASE WHEN len(missing) = 0 THEN 1.0 ELSE 0.0 END) * 100.0')} AS complete_percentage FROM v")
def complete_share(spark, folder):
    return V.complete_share(validated(spark, folder)).withColumn("complete_percentage", r6("complete_percentage"))


# --- formulas as data ----------------------------------------------------------------------------

# One formula per part: an operator by size, two features by key, a window by price.
FORMULA_SQL = """formulas AS (SELECT CASE p_size % 4 WHEN 0 THEN 'Mean(' WHEN 1 THEN 'Std(' WHEN 2 THEN 'Max(' ELSE 'Delta(' END
  || CASE p_partkey % 3 WHEN 0 THEN 'Div($close,$open)' WHEN 1 THEN '$volume' ELSE 'Sub($high,$low)' END
  || ',' || (1 + p_size) || 'd' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ')' END AS expr FROM part)"""


def formulas(spark, folder):
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.concat(
            F.when(size % 4 == 0, "Mean(").when(size % 4 == 1, "Std(").when(size % 4 == 2, "Max(").otherwise("Delta("),
            F.when(key % 3 == 0, "Div($close,$open)").when(key % 3 == 1, "$volume").otherwise("Sub($high,$low)"),
            F.lit(","), (size + 1).cast("string"), F.lit("d"), F.when(key % 7 == 0, "").otherwise(")"),
        ).alias("expr")
    )


@query(
    "formula_usage",
    f"""WITH {FORMULA_SQL} SELECT expr, array_to_string(list_sort(list_distinct(regexp_extract_all(expr, '\\$(\\w+)', 1))), ',') AS features,
array_to_string(list_sort(list_distinct(regexp_extract_all(expr, '([A-Za-z]\\w*)\\(', 1))), ',') AS operators,
CAST(regexp_extract(expr, ',(\\d+)d', 1) AS INTEGER) AS longest_window FROM formulas""",
)
def formula_usage(spark, folder):
    return V.formula_usage(formulas(spark, folder))


@query("feature_usage", f"WITH {FORMULA_SQL} SELECT feature, count(*) AS formulas FROM (SELECT unnest(list_distinct(regexp_extract_all(expr, '\\$(\\w+)', 1))) AS feature FROM formulas) GROUP BY 1")
def feature_usage(spark, folder):
    return V.feature_usage(formulas(spark, folder))


@query(
    "candidate_validity",
    f"""WITH {FORMULA_SQL}, d AS (SELECT expr, count(*) AS n, ends_with(expr, ')') AS ok, ends_with(expr, ')') AND NOT contains(expr, 'open') AS masked FROM formulas GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_lines, {q6('1.0 - count(*) / CAST(sum(n) AS DOUBLE)')} AS duplicate_rate,
count(*) FILTER (ok) AS valid_default, count(*) FILTER (masked) AS valid_masked, {q6('count(*) FILTER (ok) / CAST(count(*) AS DOUBLE)')} AS valid_rate_default, {q6('count(*) FILTER (masked) / CAST(count(*) AS DOUBLE)')} AS valid_rate_masked FROM d""",
)
def candidate_validity(spark, folder):

    sets = {"default": FormulaOptions(), "masked": FormulaOptions(features=frozenset(["close", "volume", "high", "low"]))}
    out = V.candidate_validity(formulas(spark, folder).withColumnRenamed("expr", "line"), sets)
    return out.select("total", "distinct_lines", "valid_default", "valid_masked", *[r6(c).alias(c) for c in ("duplicate_rate", "valid_rate_default", "valid_rate_masked")])


@query(
    "formula_table",
    f"""WITH {FORMULA_SQL}, lines AS (SELECT expr, CASE WHEN length(expr) % 2 = 0 THEN replace(replace(expr, '$', ''), ',', ' , ') ELSE ' ' || expr END AS line FROM formulas), u AS (SELECT DISTINCT expr, line FROM lines)
SELECT line, ends_with(expr, ')') AS valid, CASE WHEN ends_with(expr, ')') THEN expr END AS canonical,
CASE WHEN ends_with(expr, ')') THEN array_to_string(list_sort(list_distinct(regexp_extract_all(expr, '\\$(\\w+)', 1))), ',') END AS features,
CASE WHEN ends_with(expr, ')') THEN CAST(regexp_extract(expr, ',(\\d+)d', 1) AS INTEGER) ELSE 0 END AS longest_window FROM u""",
)
def formula_table(spark, folder):
    """Loosely written formulas read by a table function of SQL."""
    expr = F.col("expr")
    loose = F.replace(F.replace(expr, F.lit("$"), F.lit("")), F.lit(","), F.lit(" , "))
    lines = formulas(spark, folder).select(F.when(F.length(expr) % 2 == 0, loose).otherwise(F.concat(F.lit(" "), expr)).alias("line")).distinct()
    V.register_formula_table(spark)
    out = spark.sql("SELECT line, i.* FROM {lines}, LATERAL formula_info(line) i", lines=lines)
    return out.select("line", "valid", "canonical", F.array_join("features", ",").alias("features"), F.coalesce("longest_window", F.lit(0)).alias("longest_window"))


@query(
    "candidate_grid_scores",
    f"""WITH {PANEL_SQL}, f AS (SELECT date, {', '.join(f"CASE WHEN count({c}) OVER w{n} = {n} THEN {a}({c}) OVER w{n} END AS {a}_{c}_{n}" for a in ('avg', 'max') for c in ('close', 'volume') for n in (3, 5))},
lead(close, 1) OVER s / nullif(close, 0) - 1.0 AS y FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY date_idx), w3 AS (PARTITION BY symbol ORDER BY date_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY symbol ORDER BY date_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
l AS ({' UNION ALL '.join(f"SELECT '{op}(${c},{n}d)' AS expr, date, {a}_{c}_{n} AS x, y FROM f" for op, a in (('Mean', 'avg'), ('Max', 'max')) for c in ('close', 'volume') for n in (3, 5))}),
z AS (SELECT expr, date, coalesce((x - avg(x) OVER d) / nullif(stddev_pop(x) OVER d, 0), 0) AS x, coalesce((y - avg(y) OVER d) / nullif(stddev_pop(y) OVER d, 0), 0) AS y FROM l WINDOW d AS (PARTITION BY expr, date)),
i AS (SELECT expr, date, covar_pop(x, y) / CASE WHEN stddev_pop(x) < 1e-3 OR stddev_pop(y) < 1e-3 THEN 1.0 ELSE stddev_pop(x) * stddev_pop(y) END AS ic FROM z GROUP BY 1, 2)
SELECT expr, {q6('avg(ic)')} AS ic FROM i GROUP BY 1""",
)
def candidate_grid_scores(spark, folder):
    """The grid of formulas (a small table of texts) scored on the whole panel in one job."""

    grid = V.candidate_grid(spark, ["close", "volume"], [3, 5], ["Mean", "Max"])
    exprs = [r["expr"] for r in grid.select("expr").collect()]
    return score_candidates(panel(spark, folder), exprs, FORWARD).select("expr", r6("ic").alias("ic"))


@query(
    "ensemble_report",
    f"""WITH {MEMBERS_SQL}, c AS (SELECT p_type AS win, p_name AS expr FROM part GROUP BY 1, 2), f AS (SELECT DISTINCT p_name AS expr FROM part WHERE p_size > 45),
t AS (SELECT expr, weight FROM members ORDER BY abs(weight) DESC, expr LIMIT 10)
SELECT 'window_ic' AS section, p_type AS key, {q6('avg(p_size) / 100.0')} AS value FROM part GROUP BY p_type
UNION ALL SELECT 'contribution', win, CAST(count(f.expr) AS DOUBLE) FROM c LEFT JOIN f ON c.expr = f.expr GROUP BY win
UNION ALL SELECT 'top_weight', expr, {q6('weight')} FROM t
UNION ALL SELECT 'weights', 'count', CAST(count(*) AS DOUBLE) FROM members UNION ALL SELECT 'weights', 'mean', {q6('avg(weight)')} FROM members
UNION ALL SELECT 'weights', 'std', {q6('stddev_samp(weight)')} FROM members UNION ALL SELECT 'weights', 'min', {q6('min(weight)')} FROM members
UNION ALL SELECT 'weights', 'max', {q6('max(weight)')} FROM members UNION ALL SELECT 'weights', 'positive', CAST(count(*) FILTER (weight > 0) AS DOUBLE) FROM members
UNION ALL SELECT 'weights', 'negative', CAST(count(*) FILTER (weight < 0) AS DOUBLE) FROM members""",
)
def ensemble_report(spark, folder):
    p = table(spark, folder, "part")
    collected = p.select(F.col("p_type").alias("window"), F.col("p_name").alias("expr"))
    final = p.filter("p_size > 45").select(F.col("p_name").alias("expr"))
    ics = p.groupBy(F.col("p_type").alias("window")).agg((F.avg("p_size") / 100.0).alias("ic"))
    out = V.ensemble_report(members(spark, folder), K.window_contributions(collected, final), ics)
    return out.select("section", "key", r6("value").alias("value"))


@query(
    "rolling_summary",
    f"""WITH w AS (SELECT p_brand, avg(p_size) AS train_ic, avg(CASE WHEN p_size > 25 THEN p_retailprice / 1000.0 END) AS deploy_ic, CASE WHEN p_brand LIKE '%1%' THEN NULL ELSE avg(p_size) / 50.0 END AS deploy_rank_ic FROM part GROUP BY 1)
SELECT count(*) AS windows, {q6('avg(train_ic)')} AS train_ic, {q6('avg(deploy_ic)')} AS deploy_ic, {q6('avg(deploy_rank_ic)')} AS deploy_rank_ic FROM w""",
)
def rolling_summary(spark, folder):
    p = table(spark, folder, "part")
    w = p.groupBy("p_brand").agg(
        F.avg("p_size").alias("train_ic"),
        F.avg(F.when(F.col("p_size") > 25, F.col("p_retailprice") / 1000.0)).alias("deploy_ic"),
        F.when(~F.col("p_brand").contains("1"), F.avg("p_size") / 50.0).alias("deploy_rank_ic"),
    )
    out = V.rolling_summary(w)
    return out.select("windows", *[r6(c).alias(c) for c in ("train_ic", "deploy_ic", "deploy_rank_ic")])


