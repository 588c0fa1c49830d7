"""Scores, screens, weights, swaps and returns. All per (date) or per (account, date), for all dates at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored
from .cross_section import median_fill, zscore_guarded, zscore_sample
from .metrics import combine
from .panel import Panel
from .scale import group_percentiles, max_group_rows, position_in_group, prefix_scan, small_side, top_in_group

# Screen and sizing limits.
MIN_PRICE = 5.0
MIN_DOLLAR_VOLUME = 1_000_000.0
MAX_POSITION = 0.15
MAX_POSITIONS = 20
COST_RATE = 0.0015


def factor_score(panel: Panel, weights: Mapping[str, float], min_valid: int = 2, name: str = "score") -> Panel:
    """Sum of weight * guarded z-score. A name with none of the factors on a day is not scored, so it is never held."""
    present = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in weights])
    marked = panel.over(panel.df.withColumn("_present", present))
    scored = combine(zscore_guarded(marked, list(weights), min_valid), weights, name)
    return scored.over(scored.df.withColumn(name, F.when(F.col("_present"), F.col(name))).drop("_present"))


def raw_score(panel: Panel, weights: Mapping[str, float], name: str = "score") -> Panel:
    return combine(panel, weights, name)


def proxy_score(panel: Panel, weights: Mapping[str, float] | None = None, per_unit: float = 0.02) -> Panel:
    """Valuation proxy: filled, weighted, standardised; ``predicted_return`` is the z-score times ``per_unit``."""
    weights = weights or {"pe_ratio": -0.3, "pb_ratio": -0.3}
    scored = combine(median_fill(panel, list(weights)), weights)
    z = zscore_sample(scored, ["score"])
    return z.over(z.df.withColumn("predicted_return", F.col("score") * F.lit(per_unit)))


def ranked(df: DataFrame, score: str, by: Sequence[str] = ("date",), n_symbols: int | None = None) -> DataFrame:
    """``rank`` 1..n per group, best first, ties by symbol; rows without a score are dropped."""
    valid = df.filter(F.col(score).isNotNull())
    placed = position_in_group(valid, by, [F.col(score).desc(), F.col("symbol")], "rank", n_symbols)
    return placed.withColumn("rank", F.col("rank") + 1)


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k best per date, with rank, ties by symbol."""
    return top_in_group(df.filter(F.col(score).isNotNull()), ["date"], [F.col(score).desc(), F.col("symbol")], k, "rank")


def latest_top_k(df: DataFrame, score: str, k: int, day=None) -> DataFrame:
    """The k best of one date (the last one by default): a top-k sort, no window."""
    at = F.lit(day).cast("date") if day is not None else df.agg(F.max("date")).scalar()
    best = df.filter((F.col("date") == at) & F.col(score).isNotNull()).orderBy(F.col(score).desc(), "symbol").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), "symbol")))


def screen_reason(price: Column, volume: Column, min_price: float = MIN_PRICE, min_value: float = MIN_DOLLAR_VOLUME) -> Column:
    """``price``, ``volume`` or ``passed``."""
    return (
        F.when(price.isNull() | (price < min_price), "price")
        .when(volume.isNull() | (volume * price < min_value), "volume")
        .otherwise("passed")
    )


def liquid(df: DataFrame, price: str = "close", volume: str = "volume", min_price: float = MIN_PRICE, min_value: float = MIN_DOLLAR_VOLUME) -> DataFrame:
    return df.filter((F.col(price) >= min_price) & (F.col(volume) * F.col(price) >= min_value))


def screen_counts(df: DataFrame, price: str = "close", volume: str = "volume", by: Sequence[str] = ("date",)) -> DataFrame:
    return df.groupBy(*by, screen_reason(F.col(price), F.col(volume)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _scored_counts(panel: Panel, score: str) -> DataFrame:
    return small_side(panel.df.filter(F.col(score).isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("_n")), panel.n_dates)


def _days(df: DataFrame) -> list[str]:
    return [c for c in ("date", "date_idx") if c in df.columns]


def long_only(
    panel: Panel,
    score: str,
    quantile: float = 0.2,
    max_positions: int = MAX_POSITIONS,
    max_weight: float = MAX_POSITION,
    at_least_one: bool = True,
    min_names: int = 0,
) -> DataFrame:
    """(date, date_idx, symbol, rank, weight): equal weights of the top quantile, capped in number and size."""
    n = F.floor(F.col("_n") * F.lit(float(quantile)))
    n = F.least(F.lit(max_positions), F.greatest(n, F.lit(1)) if at_least_one else n)
    best = top_k(panel.df.select(*_days(panel.df), "symbol", score), score, max_positions)
    rows = best.join(_scored_counts(panel, score), "date").withColumn("_k", n)
    held = rows.filter((F.col("rank") <= F.col("_k")) & (F.col("_n") >= min_names))
    return held.select(*_days(held), "symbol", "rank", F.least(F.lit(1.0) / F.col("_k"), F.lit(max_weight)).alias("weight"))


def long_short(
    panel: Panel, score: str, quantile: float = 0.2, max_positions: int = MAX_POSITIONS, max_weight: float = MAX_POSITION
) -> DataFrame:
    """(date, date_idx, symbol, weight): half the money on each side; a name in both quantiles is short."""
    side = max_positions // 2
    valid = panel.df.filter(F.col(score).isNotNull()).select(*_days(panel.df), "symbol", score)
    best = top_k(valid, score, side).withColumn("_sign", F.lit(1.0))
    worst = top_in_group(valid, ["date"], [F.col(score), F.col("symbol").desc()], side, "rank").withColumn("_sign", F.lit(-1.0))
    n = F.least(F.floor(F.col("_n") * F.lit(float(quantile))), F.lit(side))
    rows = best.unionByName(worst).join(_scored_counts(panel, score), "date").withColumn("_k", n).filter(F.col("rank") <= F.col("_k"))
    size = F.least(F.lit(0.5) / F.col("_k"), F.lit(max_weight))
    # With more than half of the names on each side a name may be in both; the short side counts.
    weight = F.min(F.col("_sign") * size).alias("weight")
    return rows.groupBy(*_days(rows), "symbol").agg(weight)


def rebalance_dates(df: DataFrame) -> DataFrame:
    """First trading day of each month."""
    return df.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date"))


def factor_sets_as_of(months: DataFrame, sets: DataFrame) -> DataFrame:
    """The factor set of each month, or the latest one before it; broken sets do not count.

    ``sets``: (month, exprs, weights), one row per month. The latest set is a prefix scan over the months.
    """
    good = sets.filter((F.size("exprs") == F.size("weights")) & (F.size("exprs") > 0))
    stacked = months.select("month").distinct().withColumn("_ask", F.lit(1)).join(
        good.select("month", F.struct("month", "exprs", "weights").alias("_set")), "month", "full_outer"
    )
    stacked = cut(stacked)
    filled = prefix_scan(stacked, [F.col("month")], {"_now": ("last", "_set")}, stacked.count()).filter(F.col("_ask") == 1)
    return filled.select("month", F.col("_now.month").alias("from_month"), "_now.exprs", "_now.weights")


def weight_changes(weights: DataFrame, step: str = "date_idx") -> DataFrame:
    """(step, symbol, weight, change) against the step before; ``weight`` 0 with a negative change is a sale.

    Each weight counts at its own step and, negated, at the next one, so no step is joined with another.
    """
    moves = F.array(
        F.struct(F.col(step).alias("s"), F.col("weight").alias("w"), F.col("weight").alias("d")),
        F.struct((F.col(step) + 1).alias("s"), F.lit(0.0).alias("w"), (-F.col("weight")).alias("d")),
    )
    return (
        weights.select("symbol", F.explode(moves).alias("_m"))
        .groupBy(F.col("_m.s").alias(step), "symbol")
        .agg(F.sum("_m.w").alias("weight"), F.sum("_m.d").alias("change"))
    )


def portfolio_diff(weights: DataFrame, step: str = "date_idx") -> DataFrame:
    """What to do at each rebalance: ``sell`` names that left, ``set`` the weight of the rest."""
    moves = weight_changes(weights, step)
    steps = weights.select(step).distinct()
    kept = moves.join(steps, step, "left_semi")
    return kept.withColumn("action", F.when(F.col("weight") == 0, "sell").otherwise("set"))


def swap_decision(status: DataFrame, k: int, n_swap: int, min_hold_days: int = 1, by: Sequence[str] = ("date",)) -> DataFrame:
    """Buy and sell lists per group: (by, symbol, action) with ``swap_in``, ``swap_out`` or ``open``.

    ``status``: (by, symbol, buyable, sellable, signal, days_holded), days_holded NULL when not held. The i-th best
    candidate replaces the i-th worst holding while it is better, up to ``n_swap``; the next candidates fill the
    free places. Candidates and holdings are ranked once and meet by rank, at most ``n_swap`` rows per group.
    """
    by = list(by)
    valid = status.filter(F.col("signal").isNotNull())
    held = F.col("days_holded").isNotNull()
    candidates = valid.filter(~held & F.col("buyable"))
    sellable = valid.filter(held & F.col("sellable") & (F.col("days_holded") >= min_hold_days))
    slim = [*by, "symbol", "signal"]
    best = top_in_group(candidates.select(*slim), by, [F.col("signal").desc(), F.col("symbol")], n_swap + k, "_at")
    worst = top_in_group(sellable.select(*slim), by, [F.col("signal"), F.col("symbol").desc()], max(n_swap, 1), "_at")
    swaps = F.col("_at") <= n_swap
    outgoing = worst.filter(swaps).select(*by, "_at", F.col("symbol").alias("out"), F.col("signal").alias("out_signal"))
    pairs = best.filter(swaps).join(outgoing, [*by, "_at"]).filter(F.col("signal") > F.col("out_signal"))
    free = status.groupBy(*by).agg(F.greatest(F.lit(k) - F.count("days_holded"), F.lit(0)).alias("_free"))
    swapped = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_s"))
    room = free.join(swapped, by, "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    opens = (
        best.join(room, by)
        .filter((F.col("_at") > F.col("_s")) & (F.col("_at") <= F.col("_s") + F.col("_free")))
        .select(*by, "symbol", F.lit("open").alias("action"))
    )
    both = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("symbol").alias("symbol"), F.lit("swap_in").alias("action")),
                F.struct(F.col("out").alias("symbol"), F.lit("swap_out").alias("action")),
            )
        ).alias("_a"),
    ).select(*by, "_a.*")
    return opens.unionByName(both)


def cash_allocation(buys: DataFrame, cash: float, risk: float = 0.95, by: Sequence[str] = ("date",)) -> DataFrame:
    """Equal money per buy: (value, amount = value / price)."""
    value = F.lit(float(cash) * float(risk)) / F.count(F.lit(1)).over(Window.partitionBy(*by))
    return buys.withColumn("value", value).withColumn("amount", F.try_divide(F.col("value"), F.col("price")))


def portfolio_returns(weights: DataFrame, returns: DataFrame, cost_rate: float = COST_RATE, step: str = "date_idx") -> DataFrame:
    """(step, gross, cost, net): weights at a step earn the return to the next one, less costs on traded weight."""
    gross = (
        weights.join(returns.select("symbol", step, "ret"), ["symbol", step])
        .groupBy(step)
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    )
    cost = weight_changes(weights, step).groupBy(step).agg((F.sum(F.abs("change")) * F.lit(cost_rate)).alias("cost"))
    return gross.join(cost, step).withColumn("net", F.col("gross") - F.col("cost"))


def risk_summary(daily: DataFrame, ret: str = "net", order: str = "date_idx", periods: float = 252.0, benchmark: str | None = None) -> DataFrame:
    """Annual return, Sharpe ratio and largest drawdown of a daily series; also in excess of a benchmark column.

    The series (one row per date) is written once; running sums and maxima are prefix scans over it.
    """
    series = {"": F.col(ret)}
    if benchmark:
        series["excess_"] = F.col(ret) - F.col(benchmark)
    df = cut(daily.select(order, *[c.alias(f"{p}_r") for p, c in series.items()]))
    n = df.count()
    df = prefix_scan(df, [F.col(order)], {f"{p}_cum": ("sum", f"{p}_r") for p in series}, n)
    df = prefix_scan(df, [F.col(order)], {f"{p}_top": ("max", f"{p}_cum") for p in series}, n)
    df = df.withColumns({f"{p}_dd": F.col(f"{p}_cum") - F.greatest(f"{p}_top", F.lit(0.0)) for p in series})
    out = []
    for p in series:
        out += [
            (F.avg(f"{p}_r") * periods).alias(f"{p}annual_return"),
            (F.try_divide(F.avg(f"{p}_r"), F.stddev_samp(f"{p}_r")) * F.sqrt(F.lit(periods))).alias(f"{p}sharpe"),
            F.min(f"{p}_dd").alias(f"{p}max_drawdown"),
        ]
    return df.agg(*out)


def score_summary(df: DataFrame, score: str, unique: Sequence[str]) -> DataFrame:
    """Count, extremes, mean and quantiles of a score. What made it runs once: the scores are stored before they are read."""
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    df = stored(df.select(*dict.fromkeys([score, *unique])), "scores")
    rows = max_group_rows(df, [])
    q = group_percentiles(df, [], [score], probs, unique, rows)
    base = df.agg(F.count(score).alias("count"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"))
    values = q.select(score).scalar()
    return base.withColumns({f"p{round(p * 100)}": F.get(values, F.lit(i)) for i, p in enumerate(probs)})


def weight_summary(weights: DataFrame) -> DataFrame:
    return weights.agg(
        F.count(F.when(F.col("weight") != 0, 1)).alias("non_zero"), F.sum(F.abs("weight")).alias("l1")
    )

