"""Elementwise, rolling and cross-sectional operators on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import scalar as S
from ..operators import cross_section as X
from ..operators.panel import densify
from ..plans.evaluate import OWN_ROWS, factor_table
from ..plans.formula import FormulaOptions, feature
from .bars import DAILY_SQL, daily
from .base import q6, query, r6
from .fixtures import PANEL_SQL, panel

SERIES = "PARTITION BY symbol ORDER BY date_idx"


def windows(*lengths: int) -> str:
    frames = [f"w{n} AS ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in lengths]
    return "WINDOW s AS (" + SERIES + ")" + "".join(", " + f for f in frames)


def value_sql(expr: str, *lengths: int, ctes: str = "", source: str = "panel") -> str:
    return f"WITH {PANEL_SQL}{ctes} SELECT symbol, date, {q6(expr)} AS value FROM {source} {windows(*lengths)}"


# Users by days, in the columns of the monthly panel: most users trade on few days.
USERS_PANEL_SQL = f"""{DAILY_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM daily)),
panel AS (SELECT s.symbol, c.date, c.date_idx, d.open, d.high, d.low, d.close, d.volume, d.vwap
  FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM daily) s LEFT JOIN daily d ON d.symbol = s.symbol AND d.date = c.date)"""


def users_panel(spark, folder):
    return densify(daily(spark, folder).drop("amount"))


def own_rows(sql: str, source: str = PANEL_SQL) -> str:
    """The same windows over each symbol's own rows only; other dates have no value."""
    ctes, _, select = sql.removeprefix(f"WITH {PANEL_SQL}").replace("FROM panel", "FROM own").rpartition(" SELECT symbol, date, ")
    return f"""WITH {source}, own AS (SELECT * FROM panel WHERE close IS NOT NULL){ctes}, v AS (SELECT symbol, date, {select})
SELECT symbol, date, value FROM panel LEFT JOIN v USING (symbol, date)"""


SPARSE = {"scoring_mean", "scoring_std", "scoring_med", "scoring_ema", "deploy_mean", "deploy_ema", "deploy_ref", "deploy_delta", "deploy_rank", "deploy_corr"}


def formula_query(name: str, formula, sql: str, options: FormulaOptions = FormulaOptions()):
    def run(source):
        return lambda spark, folder: factor_table(source(spark, folder), {"value": formula}, options).select("symbol", "date", r6("value").alias("value"))

    query(name, own_rows(sql) if options.dialect in OWN_ROWS else sql)(run(panel))
    if name in SPARSE:
        query(f"{name}_sparse", own_rows(sql, USERS_PANEL_SQL))(run(users_panel))


def scalar_query(name: str, build, expr: str):
    def run(spark, folder):
        return panel(spark, folder).df.select("symbol", "date", r6(build()).alias("value"))

    query(name, f"WITH {PANEL_SQL} SELECT symbol, date, {q6(expr)} AS value FROM panel")(run)


def full(n: int, x: str = "close") -> str:
    return f"count({x}) OVER w{n} = {n}"


def when_full(n: int, expr: str, x: str = "close") -> str:
    return f"CASE WHEN {full(n, x)} THEN {expr} END"


# --- elementwise ---------------------------------------------------------------------------------

close, open_, vwap, volume = (feature(n) for n in ("close", "open", "vwap", "volume"))

formula_query("expr_feature", "$close", value_sql("close"))
formula_query("expr_dsl", -abs(close - 2.0 * vwap) / (1.0 + volume), value_sql("0.0 - abs(close - vwap * 2.0) / (1.0 + volume)"))
formula_query(
    "expr_aliases",
    "max(Sub(CLOSE,open),Constant(0.5))",
    value_sql("CASE WHEN close IS NOT NULL AND open IS NOT NULL THEN greatest(close - open, 0.5) END"),
    FormulaOptions(ignore_case=True, aliases={"Max": ["Greater"], "Min": ["Less"], "Delta": ["Sub"]}),
)
formula_query("x_abs", "Abs(Sub($close,$vwap))", value_sql("abs(close - vwap)"))
formula_query("x_sign", "Sign(Sub($close,$vwap))", value_sql("sign(close - vwap)"))
formula_query("x_log", "Log(Sub($close,$vwap))", value_sql("CASE WHEN close - vwap > 0 THEN ln(close - vwap) END"))
formula_query("x_add", "Add($close,$vwap)", value_sql("close + vwap"))
formula_query("x_sub", "Sub($close,$vwap)", value_sql("close - vwap"))
formula_query("x_mul", "Mul($close,$vwap)", value_sql("close * vwap"))
formula_query("x_div", "Div($volume,Sub($high,$low))", value_sql("volume / nullif(high - low, 0)"))
formula_query("x_pow", "Pow(Div($close,$vwap),0.7)", value_sql("pow(close / vwap, 0.7)"))
formula_query("x_greater", "Greater($close,$vwap)", value_sql("CASE WHEN close IS NOT NULL AND vwap IS NOT NULL THEN greatest(close, vwap) END"))
formula_query("x_less", "Less($close,$vwap)", value_sql("CASE WHEN close IS NOT NULL AND vwap IS NOT NULL THEN least(close, vwap) END"))
formula_query("x_sqrt", "Sqrt(Sub($close,$vwap))", value_sql("sqrt(greatest(close - vwap, CASE WHEN close IS NOT NULL THEN 0.0 END))"))


def c(name: str):
    return F.col(name)


def diff():
    return c("close") - c("vwap")


scalar_query("x_protected_div", lambda: S.protected_div(c("close"), diff() / 10000.0),
             "CASE WHEN close IS NULL THEN NULL WHEN abs((close-vwap)/10000.0) > 0.001 THEN close / ((close-vwap)/10000.0) ELSE 1.0 END")
scalar_query("x_protected_sqrt", lambda: S.protected_sqrt(diff()), "sqrt(abs(close - vwap))")
scalar_query("x_protected_log", lambda: S.protected_log(diff() / 10000.0),
             "CASE WHEN close IS NULL THEN NULL WHEN abs((close-vwap)/10000.0) > 0.001 THEN ln(abs((close-vwap)/10000.0)) ELSE 0.0 END")
scalar_query("x_protected_inv", lambda: S.protected_inv(diff() / 10000.0),
             "CASE WHEN close IS NULL THEN NULL WHEN abs((close-vwap)/10000.0) > 0.001 THEN 1.0 / ((close-vwap)/10000.0) ELSE 0.0 END")
scalar_query("x_sigmoid", lambda: S.sigmoid(diff() / 10.0), "1.0 / (1.0 + exp(-((close - vwap) / 10.0)))")
scalar_query("x_protected_sigmoid", lambda: S.protected_sigmoid(diff() * 10.0),
             "1.0 / (1.0 + CASE WHEN (close-vwap)*10.0 > -100 THEN exp(-((close-vwap)*10.0)) WHEN close IS NOT NULL THEN 0.0 END)")
scalar_query("x_neg", lambda: -c("close"), "-close")
scalar_query("x_max", lambda: S.greater(c("close"), c("vwap")), "CASE WHEN close IS NOT NULL THEN greatest(close, vwap) END")
scalar_query("x_min", lambda: S.less(c("close"), c("vwap")), "CASE WHEN close IS NOT NULL THEN least(close, vwap) END")
scalar_query("x_trig", lambda: F.sin(c("vwap")) + F.cos(c("vwap")) * F.tanh(c("vwap") / 100.0), "sin(vwap) + cos(vwap) * tanh(vwap / 100.0)")
scalar_query("x_tan", lambda: F.tan(c("vwap") / 100.0), "tan(vwap / 100.0)")
scalar_query("x_exp", lambda: S.exp(diff() / 50.0), "exp((close - vwap) / 50.0)")
# Values up to exp(100) meet as logarithms, on both sides of the limit.
scalar_query("x_protected_exp", lambda: F.ln(1.0 + S.protected_exp(diff() * 5.0)),
             "ln(1.0 + CASE WHEN (close-vwap)*5.0 < 100.0 THEN exp((close-vwap)*5.0) WHEN close IS NOT NULL AND vwap IS NOT NULL THEN 0.0 END)")
scalar_query("x_expneg", lambda: S.expneg(diff() / 50.0), "exp(-((close - vwap) / 50.0))")
scalar_query("x_protected_expneg", lambda: F.ln(1.0 + S.protected_expneg(diff() * 5.0)),
             "ln(1.0 + CASE WHEN (close-vwap)*5.0 > -100.0 THEN exp(-((close-vwap)*5.0)) WHEN close IS NOT NULL AND vwap IS NOT NULL THEN 0.0 END)")
scalar_query("x_powers", lambda: S.nth_power(diff() / 100.0, 2) + S.nth_power(diff() / 100.0, 3) + S.nth_power(diff() / 100.0, 4),
             "pow((close-vwap)/100.0, 2) + pow((close-vwap)/100.0, 3) + pow((close-vwap)/100.0, 4)")
scalar_query("x_protected_powers", lambda: S.protected_nth_power(diff() * 50000.0, 2) / 1e12 + S.protected_nth_power(diff() * 50000.0, 3) / 1e18,
             "CASE WHEN close IS NULL THEN NULL WHEN abs((close-vwap)*50000.0) < 1e6 THEN pow((close-vwap)*50000.0, 2) / 1e12 + pow((close-vwap)*50000.0, 3) / 1e18 ELSE 0.0 END")
scalar_query("x_log_abs", lambda: S.log_abs(diff()), "ln(nullif(abs(close - vwap), 0))")
scalar_query("x_inverse", lambda: S.inverse(c("vwap")), "1.0 / vwap")
scalar_query("x_harmonic", lambda: S.harmonic(F.when(c("date_idx") % 2 == 0, F.floor(c("volume")).cast("double") + 1).otherwise(c("volume") + 1.05)),
             "CASE WHEN volume IS NULL THEN NULL WHEN date_idx % 2 = 0 THEN list_sum(list_transform(range(1, CAST(floor(volume) AS BIGINT) + 2), lambda i: 1.0 / i)) "
             "ELSE 0.57721566490153286 + ln(volume + 1.05) + 1.0 / (volume + 1.05) / 2.0 - pow(1.0 / (volume + 1.05), 2) / 12.0 + pow(1.0 / (volume + 1.05), 4) / 120.0 END")
scalar_query("x_polynomial", lambda: S.polynomial([c("close") / 100.0, c("vwap") / 100.0], [[0, 0], [1, 1], [2, 0], [0, 3]], [0.3, -1.7, 0.9, 0.11]),
             "0.3 + (-1.7) * (close/100.0) * (vwap/100.0) + 0.9 * pow(close/100.0, 2) + 0.11 * pow(vwap/100.0, 3)")

# --- rolling, strict -----------------------------------------------------------------------------

formula_query("ts_ref", "Ref($close,3d)", value_sql("lag(close, 3) OVER s"))
formula_query("ts_ref_ahead", "Ref($close,-2d)", value_sql("lead(close, 2) OVER s"))
formula_query("ts_delta", "Delta($close,3d)", value_sql("close - lag(close, 3) OVER s"))
formula_query("ts_mean", "Mean($vwap,5d)", value_sql(when_full(5, "avg(vwap) OVER w5"), 5))
formula_query("ts_sum", "Sum($vwap,5d)", value_sql(when_full(5, "sum(vwap) OVER w5"), 5))
formula_query("ts_std", "Std($close,5d)", value_sql(when_full(5, "stddev_samp(close) OVER w5"), 5))
formula_query("ts_var", "Var($close,5d)", value_sql(when_full(5, "var_samp(close) OVER w5"), 5))
formula_query("ts_max", "Max($close,5d)", value_sql(when_full(5, "max(close) OVER w5"), 5))
formula_query("ts_min", "Min($close,5d)", value_sql(when_full(5, "min(close) OVER w5"), 5))
formula_query("ts_med", "Med($close,6d)", value_sql(when_full(6, "quantile_disc(close, 0.5) OVER w6"), 6))

LISTS = f""", lists AS (SELECT *, list(close) OVER w6 AS xs, avg(close) OVER w6 AS mean6, count(close) OVER w6 AS present,
  count(*) OVER w6 AS seen, var_samp(close) OVER w6 AS var6 FROM panel {windows(6)})"""


def list_sql(expr: str) -> str:
    return f"WITH {PANEL_SQL}{LISTS} SELECT symbol, date, {q6(expr)} AS value FROM lists"


def moment(k: int) -> str:
    return f"(list_sum(list_transform(xs, lambda v: pow(v - mean6, {k}))) / 6.0)"


formula_query("ts_skew", "Skew($close,6d)", list_sql(f"CASE WHEN present = 6 THEN {moment(3)} / pow({moment(2)}, 1.5) END"))
formula_query("ts_kurt", "Kurt($close,6d)", list_sql(f"CASE WHEN present = 6 THEN {moment(4)} / (var6 * var6) - 3 END"))
formula_query("ts_mad", "Mad($close,6d)", list_sql("CASE WHEN present = 6 THEN list_sum(list_transform(xs, lambda v: abs(v - mean6))) / 6.0 END"))
formula_query(
    "ts_rank",
    "Rank($close,6d)",
    list_sql(
        "CASE WHEN seen = 6 THEN (len(list_filter(xs, lambda v: v > close)) + len(list_filter(xs, lambda v: v >= close)) "
        "+ CASE WHEN len(list_filter(xs, lambda v: v >= close)) > len(list_filter(xs, lambda v: v > close)) THEN 1 ELSE 0 END) / 12.0 END"
    ),
)
formula_query("ts_wma", "WMA($close,6d)", list_sql(
    "CASE WHEN present = 6 THEN (xs[2] * 1 + xs[3] * 2 + xs[4] * 3 + xs[5] * 4 + xs[6] * 5) / 15.0 END"))

_W = R.ema_weights(6)
EMA6 = " + ".join(f"xs[{i + 1}] * {w!r}" for i, w in enumerate(_W))
for _name in ("EMA", "DEMA", "TEMA"):
    formula_query(f"ts_{_name.lower()}", f"{_name}($close,6d)", list_sql(f"CASE WHEN present = 6 THEN {EMA6} END"))


def _nested_ema(depth: int) -> tuple[str, str]:
    """CTEs e1 .. e<depth>: each the 4-row EMA of the one before."""
    w = R.ema_weights(4)
    ctes, source, col = "", "panel", "close"
    for i in range(1, depth + 1):
        dot = " + ".join(f"lag({col}, {3 - k}) OVER s * {v!r}" for k, v in enumerate(w))
        ctes += f", l{i} AS (SELECT *, CASE WHEN count({col}) OVER w4 = 4 THEN {dot} END AS e{i} FROM {source} {windows(4)})"
        source, col = f"l{i}", f"e{i}"
    return ctes, source


_ctes2, _src2 = _nested_ema(2)
_ctes3, _src3 = _nested_ema(3)
TRUE_MA = FormulaOptions(dialect="core_true_ma")
formula_query("ts_dema_true", "DEMA($close,4d)", f"WITH {PANEL_SQL}{_ctes2} SELECT symbol, date, {q6('2.0*e1 - e2')} AS value FROM {_src2}", TRUE_MA)
formula_query("ts_tema_true", "TEMA($close,4d)", f"WITH {PANEL_SQL}{_ctes3} SELECT symbol, date, {q6('3.0*e1 - 3.0*e2 + e3')} AS value FROM {_src3}", TRUE_MA)

CHANGES = ", ch AS (SELECT *, coalesce(close - lag(close, 1) OVER s, 0.0) AS d FROM panel WINDOW s AS (" + SERIES + "))"
formula_query(
    "ts_rsi",
    "RSI($close,6d)",
    f"WITH {PANEL_SQL}{CHANGES} SELECT symbol, date, "
    + q6("CASE WHEN count(*) OVER w6 = 6 THEN 100.0 - 100.0 / (1.0 + avg(greatest(d, 0.0)) OVER w5 / (avg(greatest(-d, 0.0)) OVER w5 + 1e-8)) END")
    + f" AS value FROM ch {windows(5, 6)}",
)
formula_query("ts_cov", "Cov($close,$vwap,6d)", value_sql(when_full(6, "covar_samp(close, vwap) OVER w6"), 6))
formula_query(
    "ts_corr",
    "Corr($close,$volume,6d)",
    value_sql(
        when_full(6, "covar_pop(close, volume) OVER w6 * 6 / CASE WHEN var_pop(close) OVER w6 * 6 < 1e-6 OR var_pop(volume) OVER w6 * 6 < 1e-6 "
                  "THEN 1.0 ELSE sqrt(var_pop(close) OVER w6 * 6 * var_pop(volume) OVER w6 * 6) END"),
        6,
    ),
)
formula_query(
    "expr_nested",
    "Div(Mean($volume,3d),Greater(Mul(0.5,$low),-1.0))",
    value_sql("CASE WHEN count(volume) OVER w3 = 3 AND low IS NOT NULL THEN avg(volume) OVER w3 / nullif(greatest(low * 0.5, -1.0), 0) END", 3),
)
formula_query(
    "expr_alternating",
    "Mean(CSRank(Mean($vwap,3d)),4d)",
    f"""WITH {PANEL_SQL}, a AS (SELECT *, CASE WHEN count(vwap) OVER w3 = 3 THEN avg(vwap) OVER w3 END AS m FROM panel {windows(3)}),
b AS (SELECT *, CASE WHEN m IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY m ASC NULLS LAST, symbol) - 1) / CAST(count(m) OVER (PARTITION BY date) AS DOUBLE) END AS r FROM a)
SELECT symbol, date, {q6("CASE WHEN count(r) OVER w4 = 4 THEN avg(r) OVER w4 END")} AS value FROM b {windows(4)}""",
)
query(
    "expr_many",
    f"WITH {PANEL_SQL} SELECT symbol, date, "
    + ", ".join(
        [
            f"{q6(when_full(3, 'avg(vwap) OVER w3'))} AS f0",
            f"{q6(when_full(3, 'avg(vwap) OVER w3') + ' - close')} AS f1",
            f"{q6('(' + when_full(5, 'stddev_samp(close) OVER w5') + ') / nullif(' + when_full(3, 'avg(vwap) OVER w3') + ', 0)')} AS f2",
            f"{q6('close / nullif(lag(close, 2) OVER s, 0)')} AS f3",
        ]
    )
    + f" FROM panel {windows(3, 5)}",
)(
    lambda spark, folder: factor_table(
        panel(spark, folder),
        {
            "f0": "Mean($vwap,3d)",
            "f1": "Sub(Mean($vwap,3d),$close)",
            "f2": "Div(Std($close,5d),Mean($vwap,3d))",
            "f3": "Div($close,Ref($close,2d))",
        },
    ).select("symbol", "date", *[r6(f"f{i}").alias(f"f{i}") for i in range(4)])
)

# --- the other two dialects ----------------------------------------------------------------------

SCORING, DEPLOY = FormulaOptions(dialect="scoring"), FormulaOptions(dialect="deploy")
for _op, _agg in [("Mean", "avg"), ("Sum", "sum"), ("Std", "stddev_samp"), ("Var", "var_samp"), ("Max", "max"), ("Min", "min"), ("Med", "median")]:
    formula_query(f"scoring_{_op.lower()}", f"{_op}($vwap,6d)", value_sql(f"{_agg}(vwap) OVER w6", 6), SCORING)
    if _op not in ("Var", "Sum"):
        _d = {"stddev_samp": "stddev_pop"}.get(_agg, _agg)
        formula_query(f"deploy_{_op.lower()}", f"{_op}($vwap,6d)", value_sql(f"CASE WHEN count(vwap) OVER w6 = count(*) OVER w6 THEN {_d}(vwap) OVER w6 END", 6), DEPLOY)
formula_query("deploy_var", "Var($vwap,6d)", value_sql("CASE WHEN count(vwap) OVER w6 = count(*) OVER w6 THEN var_pop(vwap) OVER w6 END", 6), DEPLOY)
formula_query("scoring_mad", "Mad($close,6d)", list_sql("list_sum(list_transform(xs, lambda v: abs(v - mean6))) / len(xs)").replace("list(close)", "list(close) FILTER (close IS NOT NULL)"), SCORING)
formula_query("scoring_div", "Div($close,Add($vwap,0.001))", value_sql("close / nullif(vwap + 0.001 + 1e-8, 0)"), SCORING)
formula_query("scoring_log", "Log(Sub($close,$vwap))", value_sql("ln(abs(close - vwap) + 1e-8)"), SCORING)
formula_query("scoring_greater", "Greater($close,$vwap)", value_sql("CASE WHEN close > vwap THEN 1.0 WHEN close IS NOT NULL THEN 0.0 END"), SCORING)
formula_query("scoring_less", "Less($close,$vwap)", value_sql("CASE WHEN close < vwap THEN 1.0 WHEN close IS NOT NULL THEN 0.0 END"), SCORING)
formula_query("deploy_log", "Log(Sub($close,$vwap))", value_sql("CASE WHEN close IS NOT NULL THEN ln(greatest(close - vwap, 1e-8)) END"), DEPLOY)
DEPLOY_LISTS = LISTS.replace("AS var6", "AS var6, median(close) OVER w6 AS med6")
formula_query(
    "deploy_mad",
    "Mad($close,6d)",
    f"WITH {PANEL_SQL}{DEPLOY_LISTS} SELECT symbol, date, "
    + q6("CASE WHEN present = seen THEN list_median(list_transform(xs, lambda v: abs(v - med6))) END")
    + " AS value FROM lists",
    DEPLOY,
)
formula_query(
    "deploy_wma",
    "WMA($close,6d)",
    list_sql("CASE WHEN present = seen THEN list_sum(list_transform(xs, lambda v, i: v * i)) / (len(xs) * (len(xs) + 1) / 2.0) END"),
    DEPLOY,
)
formula_query(
    "deploy_ema",
    "EMA($close,6d)",
    list_sql(
        "CASE WHEN present = seen THEN list_sum(list_transform(xs, lambda v, i: v * pow(1.0 - 2.0 / (len(xs) + 1), len(xs) - i) "
        "* CASE WHEN i = 1 THEN 1.0 ELSE 2.0 / (len(xs) + 1) END)) END"
    ),
    DEPLOY,
)
formula_query("deploy_ref", "Ref($close,3d)", value_sql("lag(close, 2) OVER s"), DEPLOY)
formula_query("deploy_delta", "Delta($close,3d)", value_sql("CASE WHEN count(*) OVER w3 < 3 THEN 0.0 ELSE close - lag(close, 2) OVER s END", 3), DEPLOY)
formula_query(
    "deploy_rank",
    "Rank($close,6d)",
    f"WITH {PANEL_SQL}, h AS (SELECT *, list(close) FILTER (close IS NOT NULL) OVER w120 AS xs FROM panel {windows(120)}) SELECT symbol, date, "
    + q6("CASE WHEN close IS NOT NULL THEN (len(list_filter(xs, lambda v: v < close)) + len(list_filter(xs, lambda v: v <= close)) + 1) / (2.0 * len(xs)) END")
    + " AS value FROM h",
    DEPLOY,
)
formula_query("deploy_cov", "Cov($close,$vwap,6d)", value_sql("CASE WHEN count(*) OVER w6 < 6 THEN 0.0 WHEN count(close) OVER w6 = 6 THEN covar_samp(close, vwap) OVER w6 END", 6), DEPLOY)
formula_query("deploy_corr", "Corr($close,$vwap,6d)", value_sql("CASE WHEN count(*) OVER w6 < 6 THEN 0.0 WHEN count(close + vwap) OVER w6 = 6 THEN covar_pop(close, vwap) OVER w6 / (stddev_pop(close) OVER w6 * stddev_pop(vwap) OVER w6) END", 6), DEPLOY)
# The recursive mean in closed form: weight a(1-a)^k of the k-th last row, (1-a)^k for the first one.
formula_query(
    "scoring_ema",
    "EMA($close,5d)",
    f"""WITH {PANEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k FROM panel),
e AS (SELECT a.symbol, a.date, sum(b.close * pow(2.0/3.0, a.k - b.k) * CASE WHEN b.k = 0 THEN 1.0 ELSE 1.0/3.0 END) AS x
  FROM n a JOIN n b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY 1, 2) SELECT symbol, date, {q6("x")} AS value FROM e""",
    SCORING,
)


# --- partial windows over own rows ---------------------------------------------------------------


def partial_query(name: str, build, expr: str, *lengths: int):
    """Over the bars themselves: a window counts the rows a symbol has."""

    def run(source):
        def value(spark, folder):
            own = source(spark, folder).df.filter(F.col("close").isNotNull())
            return own.select("symbol", "date", r6(build(R.Frames())).alias("value"))

        return value

    sql = value_sql(expr, *lengths, source="own")
    own = ", own AS (SELECT * FROM panel WHERE close IS NOT NULL)"
    query(name, sql.replace(PANEL_SQL, PANEL_SQL + own))(run(panel))
    query(f"{name}_sparse", sql.replace(PANEL_SQL, USERS_PANEL_SQL + own))(run(users_panel))


partial_query("rolling_min_periods", lambda f: R.partial(c("vwap"), 6, "mean", f, 4), "CASE WHEN count(vwap) OVER w6 >= 4 THEN avg(vwap) OVER w6 END", 6)
partial_query("rolling_median", lambda f: R.partial(c("vwap"), 6, "median", f, 2), "CASE WHEN count(vwap) OVER w6 >= 2 THEN median(vwap) OVER w6 END", 6)
partial_query("rolling_shift", lambda f: R.ref(c("close"), 4, f), "lag(close, 4) OVER s")
partial_query("rolling_annualised_std", lambda f: R.annualised_std(c("close") / 100.0, 6, f), "CASE WHEN count(close) OVER w6 >= 3 THEN stddev_samp(close / 100.0) OVER w6 * sqrt(504.0) END", 6)
partial_query("rolling_pair_corr", lambda f: R.partial_corr(c("close"), c("vwap"), 6, f, 3),
              "CASE WHEN count(close + vwap) OVER w6 >= 3 THEN covar_pop(close, vwap) OVER w6 / nullif(stddev_pop(CASE WHEN vwap IS NOT NULL THEN close END) OVER w6 * stddev_pop(vwap) OVER w6, 0) END", 6)
partial_query("rolling_diff", lambda f: R.delta(c("close"), 10, f), "close - lag(close, 10) OVER s")

# --- cross-section -------------------------------------------------------------------------------

DAY = "OVER (PARTITION BY date)"
formula_query(
    "cs_rank",
    "CSRank($vwap)",
    value_sql(f"CASE WHEN vwap IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY vwap ASC NULLS LAST, symbol) - 1) / CAST(count(vwap) {DAY} AS DOUBLE) END"),
)


def cs_query(name: str, change, expr: str, cols=("close",), ctes: str = ""):
    def run(spark, folder):
        p = panel(spark, folder)
        p = p.over(p.df.select("symbol", "date", *cols))
        return change(p).df.select("symbol", "date", r6("close").alias("value"))

    query(name, f"WITH {PANEL_SQL}{ctes} SELECT symbol, date, {q6(expr)} AS value FROM panel")(run)


cs_query("cs_zscore", lambda p: X.zscore(p, ["close"]), f"coalesce((close - avg(close) {DAY}) / nullif(stddev_pop(close) {DAY}, 0), 0)")
cs_query("cs_zscore_guarded", lambda p: X.zscore_guarded(p, ["close"], 3),
         f"coalesce(CASE WHEN count(close) {DAY} >= 3 AND stddev_pop(close) {DAY} >= 1e-8 THEN (close - avg(close) {DAY}) / stddev_pop(close) {DAY} END, 0)")
cs_query("cs_zscore_sample", lambda p: X.zscore_sample(p, ["close"]), f"(close - avg(close) {DAY}) / nullif(stddev_samp(close) {DAY}, 0)")
cs_query("cs_winsorize", lambda p: X.winsorize(p, ["close"], 0.05),
         f"CASE WHEN close IS NOT NULL THEN least(greatest(close, quantile_cont(close, 0.05) {DAY}), quantile_cont(close, 0.95) {DAY}) END")
cs_query("cs_median_fill", lambda p: X.median_fill(p, ["close"]), f"coalesce(close, median(close) {DAY})")


@query(
    "cs_average_rank",
    f"""WITH {PANEL_SQL} SELECT symbol, date, CASE WHEN volume IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY volume NULLS LAST) - 1
+ (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 END AS value FROM panel""",
)
def cs_average_rank(spark, folder):
    return X.rank_average(panel(spark, folder), "volume", "value").df.select("symbol", "date", "value")


@query(
    "cs_rank_columns",
    f"""WITH {PANEL_SQL}, r AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS rank,
count(*) OVER (PARTITION BY date) AS n FROM panel WHERE close IS NOT NULL)
SELECT symbol, date, rank, {q6("rank / CAST(n AS DOUBLE) * 100.0")} AS percentile FROM r""",
)
def cs_rank_columns(spark, folder):
    out = X.rank_columns(panel(spark, folder), "close").df
    return out.select("symbol", "date", "rank", r6("percentile").alias("percentile"))


@query(
    "cs_argmin_label",
    f"""WITH {PANEL_SQL} SELECT symbol, date, CASE WHEN open IS NULL THEN NULL WHEN abs(open - vwap) <= abs(close - vwap) AND abs(open - vwap) <= abs(high - vwap) THEN 'open'
WHEN abs(close - vwap) <= abs(high - vwap) THEN 'close' ELSE 'high' END AS label FROM panel""",
)
def cs_argmin_label(spark, folder):
    near = {n: F.abs(c(n) - c("vwap")) for n in ("open", "close", "high")}
    return panel(spark, folder).df.select("symbol", "date", X.argmin_label(near).alias("label"))
