"""Bars, joins with slow data, calendars, reshaping and style features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.rolling import Frames
from ..operators import panel as P
from ..operators import style as Y
from ..operators.cross_section import winsorize
from ..session import shared_folder
from ..sources.bars import normalise_keys, read_shares, union_symbols
from ..sources.store import select_features
from ..streaming import bars as stream
from .base import q6, query, r6, table
from .fixtures import BARS_SQL, PANEL_SQL, SESSION_SQL, bars, panel, session, trades

OHLC = ("open", "high", "low", "close", "volume", "vwap")


def rounded(df, *keys, cols=OHLC):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


def rounded_sql(cols=OHLC):
    return ", ".join(f"{q6(c)} AS {c}" for c in cols)


# --- bars ----------------------------------------------------------------------------------------


@query("session_label", "SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS session FROM events")
def session_label(spark, folder):
    return table(spark, folder, "events").select("event_id", P.session_of(F.col("ts")).alias("session"))


@query("monthly_bars", f"WITH {BARS_SQL} SELECT symbol, date, {rounded_sql()} FROM bars")
def monthly_bars(spark, folder):
    return rounded(bars(spark, folder), "symbol", "date")


@query("session_bars", f"WITH {SESSION_SQL} SELECT symbol, date, session, {rounded_sql()} FROM session")
def session_bars(spark, folder):
    return rounded(session(spark, folder), "symbol", "date", "session")


DAILY_SQL = """daily AS (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS date, first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts) AS close, CAST(sum(CAST(props->>'k' AS BIGINT)) AS DOUBLE) AS volume,
         sum(value * CAST(props->>'k' AS BIGINT)) / nullif(sum(CAST(props->>'k' AS BIGINT)), 0) AS vwap,
         CAST(sum(CAST(round(value*100) AS BIGINT) * CAST(props->>'k' AS BIGINT)) AS DOUBLE) / 100.0 AS amount
  FROM events GROUP BY 1, 2)"""


def minutes(spark, folder):
    t = trades(spark, folder)
    return t.select("symbol", F.col("ts").alias("datetime"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("k").alias("volume"))


def daily(spark, folder):
    t = minutes(spark, folder).withColumn("date", F.to_date("datetime"))
    cents = F.round(F.col("close") * 100).cast("long") * F.col("volume")
    out = P.ohlcv(t, ["symbol", "date"], F.col("datetime"), extra=[(F.sum(cents).cast("double") / 100.0).alias("amount")])
    return out.withColumn("volume", F.col("volume").cast("double"))


@query("daily_bars", f"WITH {DAILY_SQL} SELECT symbol, date, {rounded_sql()} FROM daily")
def daily_bars(spark, folder):
    out = P.daily_bars(minutes(spark, folder)).withColumn("volume", F.col("volume").cast("double"))
    return rounded(out, "symbol", "date")


@query("daily_from_any", f"WITH {DAILY_SQL} SELECT symbol, date, {rounded_sql()} FROM daily")
def daily_from_any(spark, folder):
    out = P.to_daily(minutes(spark, folder)).withColumn("volume", F.col("volume").cast("double"))
    return rounded(out, "symbol", "date")


@query("daily_passthrough", f"WITH {DAILY_SQL} SELECT symbol, date, {q6('close')} AS close, {q6('close')} AS vwap FROM daily")
def daily_passthrough(spark, folder):
    return rounded(P.to_daily(daily(spark, folder).drop("vwap")), "symbol", "date", cols=("close", "vwap"))


@query("vwap", f"SELECT event_type, {q6('sum(value * user_id) / nullif(sum(user_id), 0)')} AS vwap FROM events GROUP BY 1")
def vwap(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(r6(P.vwap(F.col("value"), F.col("user_id"))).alias("vwap"))


SHARES_SQL = "shares AS (SELECT DISTINCT s_suppkey AS symbol, round(abs(s_acctbal)) - 500.0 AS shares_outstanding FROM supplier WHERE s_suppkey % 11 <> 0)"


def shares(spark, folder):
    s = table(spark, folder, "supplier").filter("s_suppkey % 11 <> 0")
    return s.select(F.col("s_suppkey").alias("symbol"), (F.round(F.abs("s_acctbal")) - 500.0).alias("shares_outstanding")).distinct()


@query("shares_dimension", f"WITH {SHARES_SQL} SELECT CAST(symbol AS VARCHAR) AS symbol, shares_outstanding FROM shares")
def shares_dimension(spark, folder):
    """Written as the CSV file it usually comes in, and read back."""
    path = shared_folder(spark, "shares")
    s = shares(spark, folder)
    s.unionByName(s).write.option("header", "true").csv(path)
    return read_shares(spark, path)


@query(
    "market_values",
    f"""WITH {BARS_SQL}, {SHARES_SQL} SELECT symbol, date, {q6('close * shares_outstanding')} AS mktcap,
{q6('CASE WHEN shares_outstanding > 0 THEN volume / shares_outstanding ELSE 0.0 END')} AS turnover FROM bars JOIN shares USING (symbol)""",
)
def market_values(spark, folder):
    return rounded(P.with_market_values(bars(spark, folder), shares(spark, folder)), "symbol", "date", cols=("mktcap", "turnover"))


@query(
    "session_close",
    f"""WITH {SESSION_SQL} SELECT symbol, session, strftime(date + CASE session WHEN 'AM' THEN INTERVAL 12 HOUR ELSE INTERVAL 16 HOUR END, '%Y-%m-%d %H:%M:%S') AS closes FROM session""",
)
def session_close(spark, folder):
    out = P.with_session_close(session(spark, folder))
    return out.select("symbol", "session", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("closes"))


@query(
    "session_timestamp",
    f"""WITH {SESSION_SQL} SELECT symbol, session, strftime(date + INTERVAL 5 HOUR + CASE session WHEN 'AM' THEN INTERVAL 9 HOUR ELSE INTERVAL 13 HOUR END, '%Y-%m-%d %H:%M:%S') AS opens FROM session""",
)
def session_timestamp(spark, folder):
    out = P.session_timestamp(session(spark, folder), {"AM": 9 * 3600, "PM": 13 * 3600}, "America/New_York")
    return out.select("symbol", "session", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("opens"))


@query("session_returns", f"WITH {SESSION_SQL} SELECT symbol, date, session, {q6('close / nullif(open, 0) - 1.0')} AS ret FROM session")
def session_returns(spark, folder):
    out = session(spark, folder)
    return out.select("symbol", "date", "session", r6(P.session_return(F.col("open"), F.col("close"))).alias("ret"))


@query("typical_price", f"WITH {BARS_SQL} SELECT symbol, date, {q6('(high + low + close) / 3.0')} AS vwap FROM bars")
def typical_price(spark, folder):
    return bars(spark, folder).select("symbol", "date", r6(P.typical_price(F.col("high"), F.col("low"), F.col("close"))).alias("vwap"))


@query("session_multiplier", f"WITH {SESSION_SQL}, d AS (SELECT symbol, date, count(DISTINCT session) AS n FROM session GROUP BY 1, 2) SELECT {q6('avg(n)')} AS sessions, CASE WHEN avg(n) > 1.5 THEN CAST(round(avg(n)) AS INTEGER) ELSE 1 END AS multiplier FROM d")
def session_multiplier(spark, folder):
    return P.horizon_multiplier(session(spark, folder)).select(r6("sessions").alias("sessions"), "multiplier")


@query("downcast", f"WITH {DAILY_SQL} SELECT symbol, date, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close, CAST(CAST(vwap AS FLOAT) AS DOUBLE) AS vwap FROM (SELECT symbol, date, close, {q6('vwap')} AS vwap FROM daily)")
def downcast(spark, folder):
    out = P.downcast(daily(spark, folder).select("symbol", "date", "close", r6("vwap").alias("vwap")))
    return out.select("symbol", "date", F.col("close").cast("double"), F.col("vwap").cast("double"))


# --- scans ---------------------------------------------------------------------------------------


@query("union_symbols", f"WITH {BARS_SQL}, {DAILY_SQL} SELECT symbol, date, close, NULL::DOUBLE AS amount FROM bars UNION ALL SELECT symbol, date, close, amount FROM daily")
def union_query(spark, folder):
    return union_symbols([bars(spark, folder).select("symbol", "date", "close"), daily(spark, folder).select("symbol", "date", "close", "amount")])


@query("fundamentals_scan", "SELECT upper(o_orderpriority) AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders")
def fundamentals_scan(spark, folder):
    o = table(spark, folder, "orders")
    return normalise_keys(o.select(F.lower("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("value")))


@query("store_scan", f"WITH {SESSION_SQL} SELECT symbol, date, session, {q6('vwap')} AS vwap, volume FROM session WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-26' AND session IN ('PM')")
def store_scan(spark, folder):
    out = select_features(session(spark, folder), "2024-01-03", "2024-01-26", ["v*"], sessions=["PM"])
    return out.withColumn("vwap", r6("vwap"))


@query("ranged_panel", f"WITH {PANEL_SQL} SELECT symbol, date, date_idx, {q6('close')} AS close FROM panel WHERE date_idx BETWEEN 20 - 5 AND 60 + 2")
def ranged_panel(spark, folder):
    out = P.slice_positions(panel(spark, folder), 20, 60, 5, 2).df
    return out.select("symbol", "date", "date_idx", r6("close").alias("close"))


@query("recent_data", f"WITH {DAILY_SQL} SELECT symbol, date, {q6('close')} AS close FROM daily WHERE date BETWEEN DATE '2024-01-30' - 14 AND DATE '2024-01-30' - 2")
def recent_data(spark, folder):
    return rounded(P.recent(daily(spark, folder), "2024-01-30", 14, 2), "symbol", "date", cols=("close",))


@query("raw_kline", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS close, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS volume FROM events")
def raw_kline(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("value").cast("string")).alias("close"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("volume"),
    )
    return P.raw_kline(e, ["close", "volume"])


# --- calendars -----------------------------------------------------------------------------------

DENSE_SQL = DAILY_SQL + """,
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM daily))"""


@query("calendar", f"WITH {DENSE_SQL} SELECT date, date_idx FROM cal")
def calendar(spark, folder):
    e = table(spark, folder, "events")
    return P.calendar(e.select(F.to_date("ts").alias("date")))


@query(
    "densify",
    f"WITH {DENSE_SQL} SELECT s.symbol, c.date, c.date_idx, d.close, d.volume FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM daily) s LEFT JOIN daily d ON d.symbol = s.symbol AND d.date = c.date",
)
def densify(spark, folder):
    return P.densify(daily(spark, folder).select("symbol", "date", "close", "volume")).df


@query(
    "align_calendar",
    f"""WITH {DENSE_SQL}, spans AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM daily GROUP BY 1)
SELECT s.symbol, c.date, d.close FROM spans s JOIN cal c ON c.date BETWEEN s.lo AND s.hi LEFT JOIN daily d ON d.symbol = s.symbol AND d.date = c.date""",
)
def align_calendar(spark, folder):
    d = daily(spark, folder).select("symbol", "date", "close")
    return P.align_to_spans(d, P.calendar(table(spark, folder, "events").select(F.to_date("ts").alias("date"))))


@query(
    "slice_dates",
    f"""WITH {PANEL_SQL}, s AS (SELECT * FROM panel WHERE date >= DATE '1997-01-01' AND date < DATE '1999-06-01')
SELECT symbol, date, {q6('close')} AS close FROM s WHERE symbol IN (SELECT symbol FROM s WHERE close IS NOT NULL)""",
)
def slice_dates(spark, folder):
    out = P.slice_dates(panel(spark, folder), dt.date(1997, 1, 1), dt.date(1999, 6, 1), end_inclusive=False)
    return rounded(out.df, "symbol", "date", cols=("close",))


@query("resolve_features", f"WITH {BARS_SQL} SELECT symbol, date, {q6('close')} AS close, {q6('volume * 2')} AS market_cap, NULL::DOUBLE AS roe FROM bars")
def resolve_features(spark, folder):
    b = bars(spark, folder).select("symbol", "date", F.col("close").alias("CLOSE"), (F.col("volume") * 2).alias("mktcap"))
    out = P.resolve_features(b, [P.feature_name("FeatureType.Close"), "market_cap", "roe"])
    return out.select("symbol", "date", r6("close").alias("close"), r6("market_cap").alias("market_cap"), "roe")


@query("symbol_spans", f"WITH {DAILY_SQL} SELECT symbol, min(date) AS start_date, CASE WHEN max(date) = (SELECT max(date) FROM daily) THEN DATE '2024-03-01' ELSE max(date) END AS end_date FROM daily GROUP BY 1")
def symbol_spans(spark, folder):
    return P.roll_open_spans(P.symbol_spans(daily(spark, folder).select("symbol", "date")), "2024-03-01")


SPANS_SQL = f"{BARS_SQL}, spans AS (SELECT symbol, min(date) AS start_date, CAST(max(date) - to_months(CAST(symbol % 12 AS INTEGER)) AS DATE) AS end_date FROM bars GROUP BY 1)"


def shortened(spark, folder):
    return P.symbol_spans(bars(spark, folder).select("symbol", "date")).withColumn("end_date", F.add_months("end_date", (-(F.col("symbol") % 12)).cast("int")))


@query("universe_range_join", f"WITH {SPANS_SQL} SELECT b.symbol, b.date FROM bars b JOIN spans s ON b.symbol = s.symbol AND b.date BETWEEN s.start_date AND s.end_date")
def universe_range_join(spark, folder):
    return P.universe_members(bars(spark, folder).select("symbol", "date"), shortened(spark, folder))


@query(
    "incremental_append",
    f"WITH {SPANS_SQL} SELECT b.symbol, b.date, {q6('b.close')} AS close FROM bars b LEFT JOIN (SELECT * FROM spans WHERE symbol % 5 <> 0) s USING (symbol) WHERE s.end_date IS NULL OR b.date > s.end_date",
)
def incremental_append(spark, folder):
    stored = shortened(spark, folder).filter("symbol % 5 <> 0")
    return rounded(P.new_rows(bars(spark, folder), stored), "symbol", "date", cols=("close",))


@query(
    "merged_spans",
    f"""WITH {SPANS_SQL}, stored AS (SELECT * FROM spans WHERE symbol % 5 <> 0)
SELECT symbol, min(a) AS start_date, max(b) AS end_date FROM (SELECT symbol, start_date AS a, end_date AS b FROM stored UNION ALL SELECT symbol, min(date), max(date) FROM bars GROUP BY 1) GROUP BY 1""",
)
def merged_spans(spark, folder):
    return P.merge_spans(shortened(spark, folder).filter("symbol % 5 <> 0"), bars(spark, folder).select("symbol", "date"))


# --- slow data -----------------------------------------------------------------------------------

SLOW_SQL = """slow AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, last(value ORDER BY ts) AS pe_ratio FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"""


def slow(spark, folder):
    t = trades(spark, folder).filter("event_type = 'purchase'")
    return t.groupBy("symbol", "date").agg(F.max_by("price", "ts").alias("pe_ratio"))


@query("price_fundamental_join", f"WITH {DAILY_SQL}, {SLOW_SQL} SELECT symbol, date, close, pe_ratio FROM daily JOIN slow USING (symbol, date)")
def price_fundamental_join(spark, folder):
    return P.price_fundamental_join(daily(spark, folder).select("symbol", "date", "close"), slow(spark, folder))


@query(
    "asof_fill",
    f"""WITH {DAILY_SQL}, {SLOW_SQL} SELECT d.symbol, d.date, coalesce(s.pe_ratio, -1.0) AS pe_ratio FROM daily d ASOF LEFT JOIN slow s ON d.symbol = s.symbol AND d.date >= s.date""",
)
def asof_fill(spark, folder):
    return P.asof_fill(daily(spark, folder).select("symbol", "date"), slow(spark, folder), ["pe_ratio"], -1.0)


@query("asof_lookup", f"WITH {SLOW_SQL} SELECT symbol, max(date) AS date, max_by(pe_ratio, date) AS pe_ratio FROM slow WHERE date <= DATE '2024-01-20' GROUP BY 1")
def asof_lookup(spark, folder):
    return P.asof_lookup(slow(spark, folder), "2024-01-20").select("symbol", "date", "pe_ratio")


@query("latest_rows", f"WITH {DAILY_SQL} SELECT symbol, max(date) AS date, max_by(close, date) AS close FROM daily WHERE date <= DATE '2024-01-25' GROUP BY 1")
def latest_rows(spark, folder):
    return P.latest_rows(daily(spark, folder).select("symbol", "date", "close"), "2024-01-25")


@query("min_history", f"WITH {DAILY_SQL}, d AS (SELECT * FROM daily WHERE date <= DATE '2024-01-25') SELECT symbol, date, close FROM d WHERE symbol IN (SELECT symbol FROM d GROUP BY 1 HAVING count(*) >= 20)")
def min_history(spark, folder):
    return P.with_history(daily(spark, folder).select("symbol", "date", "close"), 20, "2024-01-25")


@query("symbol_diff", "WITH a AS (SELECT DISTINCT l_suppkey AS symbol FROM lineitem), b AS (SELECT DISTINCT user_id AS symbol FROM events) SELECT coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'right' WHEN b.symbol IS NULL THEN 'left' ELSE 'common' END AS side FROM a FULL JOIN b ON a.symbol = b.symbol")
def symbol_diff(spark, folder):
    left = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("symbol"))
    return P.symbol_diff(left, table(spark, folder, "events").select(F.col("user_id").alias("symbol")))


@query("dedup_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def dedup_last(spark, folder):
    return P.dedup_last(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("dedup_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def dedup_first(spark, folder):
    return P.dedup_first(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


ADJUST_SQL = """factors AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, 1.0 + last(value ORDER BY ts) / 1000.0 AS factor
  FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0 GROUP BY 1, 2),
all_factors AS (SELECT symbol, date, factor FROM factors UNION ALL
  SELECT symbol, min(date), 1.0 FROM daily WHERE symbol NOT IN (SELECT symbol FROM factors) GROUP BY 1)"""


def factors(spark, folder):
    f = slow(spark, folder).filter("symbol % 4 <> 0").select("symbol", "date", (F.lit(1.0) + F.col("pe_ratio") / 1000.0).alias("factor"))
    ipo = table(spark, folder, "events").groupBy(F.col("user_id").alias("symbol")).agg(F.min(F.to_date("ts")).alias("ipo_date"))
    return P.default_factors(ipo, f)


@query("default_factors", f"WITH {DAILY_SQL}, {ADJUST_SQL} SELECT symbol, date, {q6('factor')} AS factor FROM all_factors")
def default_factors(spark, folder):
    return rounded(factors(spark, folder), "symbol", "date", cols=("factor",))


@query(
    "readjust",
    f"""WITH {DAILY_SQL}, {ADJUST_SQL}, base AS (SELECT symbol, max_by(factor, date) AS base FROM all_factors WHERE date <= DATE '2024-01-20' GROUP BY 1),
j AS (SELECT d.*, coalesce(f.factor, 1.0) / coalesce(b.base, 1.0) AS f FROM daily d ASOF LEFT JOIN all_factors f ON d.symbol = f.symbol AND d.date >= f.date LEFT JOIN base b ON b.symbol = d.symbol)
SELECT symbol, date, {q6('close * f')} AS close, {q6('open * f')} AS open, {q6('volume / f')} AS volume, {q6('amount / nullif(volume / f, 0)')} AS vwap, {q6('f')} AS factor FROM j""",
)
def readjust(spark, folder):
    return rounded(P.readjust(daily(spark, folder), factors(spark, folder), "2024-01-20"), "symbol", "date", cols=("close", "open", "volume", "vwap", "factor"))


@query(
    "derived_fundamentals",
    f"""WITH {BARS_SQL}, d AS (SELECT symbol, date, close, volume, CASE WHEN symbol % 3 = 0 OR (symbol % 3 = 1 AND month(date) = 1) THEN NULL ELSE CAST(symbol * 10 AS DOUBLE) END AS shares,
  close * (symbol % 7 - 1) AS market_cap FROM bars),
h AS (SELECT *, CASE WHEN count(shares) OVER (PARTITION BY symbol) > 0 THEN shares WHEN market_cap > 0 THEN market_cap / close END AS s FROM d)
SELECT symbol, date, {q6('s')} AS shares_outstanding, {q6('CASE WHEN s > 0 THEN volume / s END')} AS turnover FROM h""",
)
def derived_fundamentals(spark, folder):
    s = F.col("symbol")
    b = bars(spark, folder).select(
        "symbol", "date", "close", "volume",
        F.when((s % 3 == 0) | ((s % 3 == 1) & (F.month("date") == 1)), None).otherwise((s * 10).cast("double")).alias("shares_outstanding"),
        (F.col("close") * (s % 7 - 1)).alias("market_cap"),
    )
    return rounded(P.derive_fundamentals(b), "symbol", "date", cols=("shares_outstanding", "turnover"))


# --- reshaping -----------------------------------------------------------------------------------

WIDE_SQL = SESSION_SQL + """,
wide AS (SELECT symbol, date, max(close) FILTER (session = 'AM') AS close_am, max(close) FILTER (session = 'PM') AS close_pm,
  max(volume) FILTER (session = 'AM') AS volume_am, max(volume) FILTER (session = 'PM') AS volume_pm FROM session GROUP BY 1, 2)"""


@query("sessions_to_wide", f"WITH {WIDE_SQL} SELECT * FROM wide")
def sessions_to_wide(spark, folder):
    return P.sessions_to_wide(session(spark, folder).select("symbol", "date", "session", "close", "volume"))


@query("sessions_to_long", f"WITH {WIDE_SQL} SELECT symbol, date, 'AM' AS session, close_am AS close, volume_am AS volume FROM wide UNION ALL SELECT symbol, date, 'PM', close_pm, volume_pm FROM wide")
def sessions_to_long(spark, folder):
    wide = P.sessions_to_wide(session(spark, folder).select("symbol", "date", "session", "close", "volume"))
    return P.sessions_to_long(wide.withColumnRenamed("close_am", "close_AM"))


# --- style features ------------------------------------------------------------------------------

BENCH = ["click", "purchase", "view"]
BENCH_SQL = SESSION_SQL + """,
bench_bars AS (SELECT event_type, date, session, last(price ORDER BY ts) / first(price ORDER BY ts) - 1.0 AS r FROM trades GROUP BY 1, 2, 3),
bench AS (SELECT date, session, """ + ", ".join(f"avg(r) FILTER (event_type = '{b}') AS ret_{b}" for b in BENCH) + f""" FROM bench_bars
  WHERE event_type IN ({', '.join(repr(b) for b in BENCH)}) GROUP BY 1, 2)"""
JOINED_SQL = BENCH_SQL + """,
j AS (SELECT symbol, date, session, close / open - 1.0 AS ret, ret_click, ret_purchase, ret_view,
  close / open - 1.0 - ret_click AS rel_click, close / open - 1.0 - ret_purchase AS rel_purchase, close / open - 1.0 - ret_view AS rel_view
  FROM session LEFT JOIN bench USING (date, session))"""
SERIES_W = "WINDOW w4 AS (PARTITION BY symbol, session ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY symbol, session ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


def te_sql(b, w):
    return f"CASE WHEN count(rel_{b}) OVER w{w} >= {w // 2} THEN stddev_samp(rel_{b}) OVER w{w} * sqrt(504.0) END"


def corr_sql(x, y, frame, need):
    px, py = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (
        f"CASE WHEN count({px}) OVER {frame} >= {max(need, 2)} THEN covar_pop({px}, {py}) OVER {frame} "
        f"/ nullif(stddev_pop({px}) OVER {frame} * stddev_pop({py}) OVER {frame}, 0) END"
    )


TE_SQL = JOINED_SQL + ", te AS (SELECT *, " + ", ".join(f"{te_sql(b, w)} AS te_{b}_{w}" for b in BENCH for w in (4, 8)) + f" FROM j {SERIES_W})"


def bench(spark, folder):
    return P.benchmark_returns(session(spark, folder, "event_type"), BENCH)


def joined(spark, folder):
    return Y.with_benchmarks(session(spark, folder), bench(spark, folder), BENCH)


def tracked(spark, folder):
    return Y.with_tracking(joined(spark, folder), BENCH, [4, 8])


@query("bench_pivot", f"WITH {BENCH_SQL} SELECT date, session, " + ", ".join(f"{q6(f'ret_{b}')} AS ret_{b}" for b in BENCH) + " FROM bench")
def bench_pivot(spark, folder):
    return rounded(bench(spark, folder), "date", "session", cols=[f"ret_{b}" for b in BENCH])


@query("relative_returns", f"WITH {JOINED_SQL} SELECT symbol, date, session, " + ", ".join(f"{q6(f'rel_{b}')} AS rel_ret_{b}" for b in BENCH) + " FROM j")
def relative_returns(spark, folder):
    return rounded(joined(spark, folder), "symbol", "date", "session", cols=[f"rel_ret_{b}" for b in BENCH])


@query("tracking_error", f"WITH {TE_SQL} SELECT symbol, date, session, " + ", ".join(f"{q6(f'te_{b}_{w}')} AS te_{b}_{w}" for b in BENCH for w in (4, 8)) + " FROM te")
def tracking_error(spark, folder):
    return tracked(spark, folder).select("symbol", "date", "session", *[r6(f"TE_{b}_{w}").alias(f"te_{b}_{w}") for b in BENCH for w in (4, 8)])


@query("bench_correlation", f"WITH {JOINED_SQL} SELECT symbol, date, session, " + ", ".join(f"{q6(corr_sql('ret', f'ret_{b}', 'w8', 4))} AS corr_{b}" for b in BENCH) + f" FROM j {SERIES_W}")
def bench_correlation(spark, folder):
    df = Y.with_tracking(joined(spark, folder), BENCH, [8])
    return df.select("symbol", "date", "session", *[r6(f"CORR_{b}_8").alias(f"corr_{b}") for b in BENCH])


STYLE_WIDE_SQL = TE_SQL + """,
wide AS (SELECT symbol, date, """ + ", ".join(
    f"max({c}) FILTER (session = '{s.upper()}') AS {c}_{s}" for c in ("ret", "ret_click", "te_click_4", "te_purchase_4", "te_view_4") for s in ("am", "pm")
) + """ FROM te GROUP BY 1, 2),
v AS (SELECT *, """ + ", ".join(
    f"CASE WHEN count(ret_{s}) OVER w4 >= 2 THEN stddev_samp(ret_{s}) OVER w4 * sqrt(504.0) END AS vol_{s}" for s in ("am", "pm")
) + " FROM wide WINDOW w4 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"
WIDE_W = "WINDOW w4 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY date)"


def wide(spark, folder):
    return Y.with_volatility(P.sessions_to_wide(tracked(spark, folder)), [4])


@query("session_volatility", f"WITH {STYLE_WIDE_SQL} SELECT symbol, date, {q6('vol_am')} AS vol_am, {q6('vol_pm')} AS vol_pm FROM v")
def session_volatility(spark, folder):
    return wide(spark, folder).select("symbol", "date", r6("VOL_4_am").alias("vol_am"), r6("VOL_4_pm").alias("vol_pm"))


def contrasts(spark, folder):
    return Y.with_session_contrasts(wide(spark, folder), BENCH, [4])


@query(
    "te_share",
    f"""WITH {STYLE_WIDE_SQL}, t AS (SELECT symbol, date, te_click_4_am / (vol_am + 1e-8) AS x FROM v)
SELECT symbol, date, {q6("CASE WHEN x IS NOT NULL THEN ln(1.0 + least(greatest(x, quantile_cont(x, 0.01) OVER d), quantile_cont(x, 0.99) OVER d)) END")} AS te_share FROM t WINDOW d AS (PARTITION BY date)""",
)
def te_share(spark, folder):
    df = contrasts(spark, folder).select("symbol", "date", F.col("TEshare_click_4_am").alias("te_share"))
    _, n_dates, widest = P.measure(table(spark, folder, "events"), F.to_date("ts"), F.col("user_id"))
    out = winsorize(P.Panel(df, n_dates, widest), ["te_share"], 0.01).df
    return out.select("symbol", "date", r6(F.ln(F.col("te_share") + 1.0)).alias("te_share"))  # the raw share has no upper limit


@query("te_contrast", f"WITH {STYLE_WIDE_SQL} SELECT symbol, date, {q6('te_click_4_am - te_click_4_pm')} AS dte, {q6('ln(1.0 + te_click_4_am / (te_click_4_pm + 1e-8))')} AS rte FROM v")
def te_contrast(spark, folder):
    df = contrasts(spark, folder)
    return df.select("symbol", "date", r6("DTE_click_4").alias("dte"), r6(F.ln(1.0 + F.col("RTE_click_4"))).alias("rte"))  # the ratio has no upper limit


@query("cross_correlation", f"WITH {STYLE_WIDE_SQL} SELECT symbol, date, {q6(corr_sql('ret_am', 'ret_click_pm', 'w4', 4))} AS am_pm, {q6(corr_sql('ret_pm', 'ret_click_am', 'w4', 4))} AS pm_am FROM v {WIDE_W}")
def cross_correlation(spark, folder):
    df = contrasts(spark, folder)
    return df.select("symbol", "date", r6("CROSS_CORR_click_4_AM_PM").alias("am_pm"), r6("CROSS_CORR_click_4_PM_AM").alias("pm_am"))


@query("te_change", f"WITH {STYLE_WIDE_SQL} SELECT symbol, date, {q6('te_click_4_am - lag(te_click_4_am, 10) OVER s')} AS d_am FROM v {WIDE_W}")
def te_change(spark, folder):
    return contrasts(spark, folder).select("symbol", "date", r6("dTE_click_4_am").alias("d_am"))


def argmin_sql(s):
    a, b, c = (f"coalesce(te_{x}_4_{s}, 1e300)" for x in BENCH)
    return (
        f"CASE WHEN te_click_4_{s} IS NULL AND te_purchase_4_{s} IS NULL AND te_view_4_{s} IS NULL THEN NULL "
        f"WHEN {a} <= {b} AND {a} <= {c} THEN 'click' WHEN {b} <= {c} THEN 'purchase' ELSE 'view' END"
    )


@query("closest_benchmark", f"WITH {STYLE_WIDE_SQL} SELECT symbol, date, {argmin_sql('am')} AS am, {argmin_sql('pm')} AS pm FROM v")
def closest_benchmark(spark, folder):
    df = Y.with_closest_benchmark(wide(spark, folder), BENCH, [4])
    return df.select("symbol", "date", F.col("ARGMIN_TE_4_am").alias("am"), F.col("ARGMIN_TE_4_pm").alias("pm"))


RESID_SQL = f"""r AS (SELECT symbol, date, session, ret, ret_click AS x, CASE WHEN ret_click IS NOT NULL THEN ret END AS py, CASE WHEN ret IS NOT NULL THEN ret_click END AS px FROM j),
res AS (SELECT symbol, date, session, CASE WHEN count(*) OVER w8 = 8 AND count(py) OVER w8 >= 5 THEN
  ret - (avg(py) OVER w8 + covar_pop(py, px) OVER w8 / nullif(var_pop(px) OVER w8, 0) * (x - avg(px) OVER w8)) END AS resid FROM r {SERIES_W})"""


@query("ols_residual", f"WITH {JOINED_SQL}, {RESID_SQL} SELECT symbol, date, session, {q6('resid')} AS resid FROM res")
def ols_residual(spark, folder):
    resid = Y.ols_residual_1(F.col("return"), F.col("ret_click"), 8, Y.SESSION)
    return joined(spark, folder).select("symbol", "date", "session", r6(resid).alias("resid"))


@query(
    "idiosyncratic_vol",
    f"""WITH {JOINED_SQL}, {RESID_SQL} SELECT symbol, date, session, {q6('CASE WHEN count(resid) OVER w8 >= 4 THEN stddev_samp(resid) OVER w8 * sqrt(504.0) END')} AS idiovol FROM res {SERIES_W}""",
)
def idiosyncratic_vol(spark, folder):
    df = Y.with_idiosyncratic_vol(joined(spark, folder), ["ret_click"], [8])
    return df.select("symbol", "date", "session", r6("IDIOVOL_8").alias("idiovol"))


def normal_sql(regressors: list[str]) -> str:
    """CTEs up to ``res``: residuals of the normal equations with two or three regressors, solved by Cramer's rule."""
    k, rets = len(regressors), [f"ret_{b}" for b in regressors]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in ("ret", *rets))
    cov = ", ".join(f"covar_pop(v{i}, v{j}) OVER w8 AS c{i}{j}" for i in range(k) for j in range(i, k + 1))
    at = lambda i, j: f"c{min(i, j)}{max(i, j)}"

    def det(m):
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        return "(" + " + ".join(f"{s} * {m[0][j]} * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j, s in enumerate(("1", "-1", "1"))) + ")"

    a = [[at(i, j) for j in range(k)] for i in range(k)]
    beta = [f"{det([[at(i, k) if j == b else a[i][j] for j in range(k)] for i in range(k)])} / {det(a)}" for b in range(k)]
    fitted = " + ".join(f"({x}) * d{i}" for i, x in enumerate(beta))
    return f"""n{k} AS (SELECT symbol, date, session, ret, {ok} AS ok, {", ".join(f"CASE WHEN {ok} THEN {c} END AS v{i}" for i, c in enumerate((*rets, "ret")))} FROM j WHERE ret IS NOT NULL),
m{k} AS (SELECT symbol, date, session, ok AND count(*) OVER w8 = 8 AND count(v0) OVER w8 >= 5 AS fits, {cov}, {", ".join(f"v{i} - avg(v{i}) OVER w8 AS d{i}" for i in range(k + 1))} FROM n{k} {SERIES_W}),
res{k} AS (SELECT symbol, date, session, CASE WHEN fits THEN d{k} - ({fitted}) END AS resid FROM m{k})"""


@query(
    "idiosyncratic_vol_many",
    f"""WITH {JOINED_SQL}, {normal_sql(BENCH[:2])}, {normal_sql(BENCH)},
i AS (SELECT symbol, date, session, resid, CASE WHEN count(resid) OVER w8 >= 4 THEN stddev_samp(resid) OVER w8 * sqrt(504.0) END AS vol FROM res2 {SERIES_W})
SELECT j.symbol, j.date, j.session, {q6('res2.resid')} AS resid2, {q6('res3.resid')} AS resid3, {q6('i.vol')} AS idiovol2
FROM j LEFT JOIN res2 USING (symbol, date, session) LEFT JOIN res3 USING (symbol, date, session) LEFT JOIN i USING (symbol, date, session)""",
)
def idiosyncratic_vol_many(spark, folder):
    """Two and three benchmarks at once."""
    rets = [f"ret_{b}" for b in BENCH]
    df = Y.with_idiosyncratic_vol(joined(spark, folder), rets[:2], [8])
    df = df.withColumn("_has", F.col("return").isNotNull())
    frames = Frames(("symbol", "session", "_has"), "date")
    df = Y.with_rolling_residual(Y.with_rolling_residual(df, "return", rets[:2], 8, frames, "resid2"), "return", rets, 8, frames, "resid3")
    return df.select("symbol", "date", "session", r6("resid2").alias("resid2"), r6("resid3").alias("resid3"), r6("IDIOVOL_8").alias("idiovol2"))


@query("style_features")
def style_features(spark, folder):
    _, n_dates, widest = P.measure(table(spark, folder, "events"), F.to_date("ts"), F.col("user_id"))
    return Y.style_features(session(spark, folder), bench(spark, folder), n_dates, widest, BENCH, [4, 8])


# --- live bars -----------------------------------------------------------------------------------


@query("stream_daily_bars", f"WITH {DAILY_SQL} SELECT symbol, date, {rounded_sql()} FROM daily WHERE volume > 0")
def stream_daily_bars(spark, folder):
    """The streaming aggregation on a batch frame; tests run the same function on a stream."""
    out = stream.daily_bars(minutes(spark, folder).withColumn("datetime", F.col("datetime").cast("timestamp")))
    return rounded(out.withColumn("volume", F.col("volume").cast("double")), "symbol", "date")


@query("stream_session_bars", f"WITH {SESSION_SQL}, x AS (SELECT symbol, date, session, open, high, low, close, volume, vwap FROM session WHERE volume > 0) SELECT symbol, date, session, {rounded_sql()} FROM x")
def stream_session_bars(spark, folder):
    out = stream.session_bars(minutes(spark, folder).withColumn("datetime", F.col("datetime").cast("timestamp")))
    return rounded(out.withColumn("volume", F.col("volume").cast("double")), "symbol", "date", "session")
