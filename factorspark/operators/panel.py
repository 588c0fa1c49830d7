"""Bars and panels: session and daily bars, joins with slow data, calendars, densification."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scale
from .scale import max_group_rows, measured_side, ordered_position, small_side

MAX_LOCAL_DATES = 100_000
BLOCK_DATES = 250_000  # longest part of a calendar whose gaps one window task fills
WIDE_RSD = 0.05

# The feature vocabulary, by group.
FEATURES = """
open close high low volume vwap
pe_ratio pb_ratio ps_ratio ev_to_ebitda ev_to_revenue ev_to_fcf
earnings_yield fcf_yield sales_yield dividend_yield forward_pe_ratio
shares_outstanding market_cap turnover
revenue_growth earnings_growth book_value_growth
debt_to_assets debt_to_equity current_ratio quick_ratio
roe roa roic gross_margin operating_margin net_margin
""".split()
# Features that change only with filings.
SLOW_FEATURES = """
pe_ratio pb_ratio ps_ratio ev_to_ebitda ev_to_revenue ev_to_fcf
earnings_yield fcf_yield sales_yield dividend_yield forward_pe_ratio shares_outstanding
""".split()
# Other column names a feature may arrive under.
ALIASES = {"market_cap": ["market_cap", "mktcap"]}
# Hours after midnight at which a session closes, and the offsets used to order sessions.
SESSION_CLOSE_HOUR = {"AM": 12, "PM": 16}


@dataclass(frozen=True)
class Panel:
    """A dense panel: one row per (symbol, calendar date), missing values NULL.

    ``n_dates`` is exact; ``n_symbols`` is the (estimated) width of a date, for a dense panel all its symbols. Both are measured when
    the panel is made and bound every broadcast and every per-date window made from it.
    """

    df: DataFrame
    n_dates: int
    n_symbols: int
    first: object = None  # the calendar's ends, where they are known
    last: object = None

    def over(self, df: DataFrame) -> Panel:
        return replace(self, df=df)


# --- bars ----------------------------------------------------------------------------------------


def session_of(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "AM").otherwise("PM")


def vwap(price: Column, volume: Column) -> Column:
    return F.try_divide(F.sum(price * volume), F.sum(volume))


def ohlcv(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    open="open",
    high="high",
    low="low",
    close="close",
    volume="volume",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """OHLCV and VWAP per key. Every aggregate combines map-side, so a hot symbol is reduced before the shuffle.

    With ``order`` a single fixed-width column (a time) Spark keeps first and last in a hash aggregate; a struct
    makes it sort all rows first.
    """
    return df.groupBy(*keys).agg(
        F.min_by(open, order).alias("open"),
        F.max(high).alias("high"),
        F.min(low).alias("low"),
        F.max_by(close, order).alias("close"),
        F.sum(volume).alias("volume"),
        vwap(F.col(close), F.col(volume)).alias("vwap"),
        *extra,
    )


def wall_clock(ts: Column, zone: str | None) -> Column:
    """The time a clock in ``zone`` shows, without a zone; None leaves the session's zone in charge."""
    return ts if zone is None else F.convert_timezone(None, F.lit(zone), ts.cast("timestamp_ntz"))


def _time_order(ts: str, unique: Sequence[str]) -> Column:
    return F.struct(ts, *unique) if unique else F.col(ts)


def session_bars(minute: DataFrame, ts: str = "datetime", unique: Sequence[str] = (), zone: str | None = None) -> DataFrame:
    """(symbol, date, session) bars by the clock of the exchange's ``zone``. ``unique`` breaks ties between rows with the same time."""
    local = wall_clock(F.col(ts), zone)
    tagged = minute.withColumns({"date": F.to_date(local), "session": session_of(local)})
    return ohlcv(tagged, ["symbol", "date", "session"], _time_order(ts, unique))


def daily_bars(intraday: DataFrame, ts: str = "datetime", unique: Sequence[str] = (), zone: str | None = None) -> DataFrame:
    return ohlcv(intraday.withColumn("date", F.to_date(wall_clock(F.col(ts), zone))), ["date", "symbol"], _time_order(ts, unique))


def with_session_close(df: DataFrame) -> DataFrame:
    hours = F.when(F.col("session") == "AM", SESSION_CLOSE_HOUR["AM"]).otherwise(SESSION_CLOSE_HOUR["PM"])
    return df.withColumn("timestamp", F.col("date").cast("timestamp") + F.make_dt_interval(hours=hours))


def with_market_values(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Market cap and turnover; symbols without a share count are dropped."""
    known = shares.select("symbol", "shares_outstanding").filter(F.col("shares_outstanding").isNotNull()).distinct()
    return bars.join(measured_side(known), "symbol").withColumns(
        {
            "mktcap": F.col("close") * F.col("shares_outstanding"),
            "turnover": F.when(
                F.col("shares_outstanding") > 0, F.try_divide(F.col("volume"), F.col("shares_outstanding"))
            ).otherwise(F.lit(0.0)),
        }
    )


def one_row_per_day(df: DataFrame) -> bool:
    """True when no (date, symbol) repeats."""
    top = df.groupBy("date", "symbol").count().agg(F.max("count")).first()[0]
    return (top or 0) <= 1


def to_daily(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Daily bars whatever the resolution of the input; daily input passes through."""
    if "date" not in df.columns:
        df = df.withColumn("date", F.to_date(ts))
    if one_row_per_day(df):
        return df if "vwap" in df.columns else df.withColumn("vwap", F.col("close"))
    return ohlcv(df, ["date", "symbol"], F.col(ts))


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3.0


def session_return(open: Column, close: Column) -> Column:
    return F.try_divide(close, open) - 1.0


# --- calendars and density -----------------------------------------------------------------------


def measure(df: DataFrame, date: Column, symbol: Column) -> tuple[list | None, int, int]:
    """The calendar of ``df`` (None when it is too long to hold locally), its length, and the widest date.

    One scan of two columns with a map-side combine; at most ``MAX_LOCAL_DATES`` + 1 rows come back.
    """
    per_date = (
        df.select(date.alias("date"), symbol.alias("symbol"))
        .filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.approx_count_distinct("symbol", WIDE_RSD).alias("n"))
    )
    rows = per_date.limit(MAX_LOCAL_DATES + 1).collect()
    if len(rows) <= MAX_LOCAL_DATES:
        return sorted(r["date"] for r in rows), len(rows), math.ceil(max((r["n"] for r in rows), default=0) / (1 - WIDE_RSD))
    n_dates, widest = per_date.agg(F.count(F.lit(1)), F.max("n")).first()
    return None, int(n_dates), math.ceil(widest / (1 - WIDE_RSD))


def calendar(df: DataFrame, n_dates: int | None = None) -> DataFrame:
    """Sorted distinct dates with a 0-based ``date_idx``."""
    days = df.select("date").filter(F.col("date").isNotNull()).distinct()
    n = days.limit(scale.MAX_BROADCAST_ROWS + 1).count() if n_dates is None else n_dates
    if n <= scale.MAX_BROADCAST_ROWS:
        return days.withColumn("date_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))
    return ordered_position(days, [], [F.col("date")], "date_idx")


def densify(bars: DataFrame, source: tuple[DataFrame, Column, Column] | None = None) -> Panel:
    """Give every symbol a row for every calendar date, missing features NULL.

    ``bars`` holds one row per (symbol, date). Each row fills the gap to the symbol's next row, and the first
    one also the gap before it, so the rows are made inside the one shuffle by symbol that rolling operators
    need anyway; no calendar x universe join is built. ``source`` names a cheaper table (and its date and
    symbol columns) with the same dates and symbols to take the calendar from.
    """
    spark = bars.sparkSession
    table, date, symbol = source or (bars, F.col("date"), F.col("symbol"))
    days, n_dates, _ = measure(table, date, symbol)
    # A dense date holds every symbol, also those that have no bar on it.
    seen = table.agg(F.approx_count_distinct(symbol, WIDE_RSD)).first()[0]
    widest = math.ceil((seen or 0) / (1 - WIDE_RSD))
    if days is not None:
        schema = T.StructType([T.StructField("date", bars.schema["date"].dataType), T.StructField("date_idx", T.LongType())])
        cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], schema)
    else:
        cal = calendar(table.select(date.alias("date")), n_dates)
    cal = small_side(cal, n_dates)
    features = [c for c in bars.columns if c not in ("symbol", "date")]
    if n_dates > BLOCK_DATES:
        whole = bars.select("symbol").distinct().select("symbol", F.lit(0).cast("long").alias("_lo"), F.lit(n_dates - 1).cast("long").alias("_hi"))
        dense = _filled_by_blocks(bars.join(cal, "date").drop("date"), whole, features).join(cal, "date_idx").select("symbol", "date", "date_idx", *features)
        return Panel(dense, n_dates, widest, *((days[0], days[-1]) if days else (None, None)))
    rows = Window.partitionBy("symbol").orderBy("date_idx")
    start = F.when(F.lag("date_idx").over(rows).isNull(), F.lit(0)).otherwise(F.col("date_idx"))
    stop = F.coalesce(F.lead("date_idx").over(rows), F.lit(n_dates)) - 1
    spans = bars.join(cal, "date").withColumns({"_from": start, "_to": stop})
    own = F.col("date_idx") == F.col("_at")
    dense = (
        spans.select("symbol", "date_idx", *features, F.explode(F.sequence("_from", "_to")).alias("_at"))
        .select(
            "symbol",
            F.col("_at").alias("date_idx"),
            *[F.when(own, F.col(c)).alias(c) for c in features],
        )
        .join(cal, "date_idx")
        .select("symbol", "date", "date_idx", *features)
    )
    return Panel(dense, n_dates, widest, *((days[0], days[-1]) if days else (None, None)))


def _filled_by_blocks(bars: DataFrame, spans: DataFrame, features: Sequence[str]) -> DataFrame:
    """(symbol, date_idx, features) for every date from ``_lo`` to ``_hi`` of ``spans`` (symbol, _lo, _hi), missing features NULL.

    A symbol's calendar is cut into blocks of ``BLOCK_DATES``. A blank row opens each block, so every block fills its own
    gaps and a symbol with a very long history is shared by many tasks.
    """
    size = F.lit(BLOCK_DATES).cast("long")
    block = F.floor(F.col("date_idx") / size)
    blocks = F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size)))
    blank = spans.select("symbol", "_lo", "_hi", blocks.alias("_block")).select(
        "symbol", F.greatest("_lo", F.col("_block") * size).alias("date_idx"), "_block", F.least("_hi", (F.col("_block") + 1) * size - 1).alias("_end"), F.lit(0).alias("_real")
    )
    own = bars.withColumns({"_block": block, "_real": F.lit(1)})
    rows = Window.partitionBy("symbol", "_block")
    both = own.unionByName(blank, allowMissingColumns=True).withColumns({
        "_next": F.lead("date_idx").over(rows.orderBy("date_idx", "_real")),
        "_end": F.max("_end").over(rows),
    })
    both = both.withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_end"))).filter("_to >= date_idx")
    at = both.select("symbol", "date_idx", *features, F.explode(F.sequence("date_idx", "_to")).alias("_at"))
    return at.select("symbol", F.col("_at").alias("date_idx"), *[F.when(F.col("date_idx") == F.col("_at"), F.col(c)).alias(c) for c in features])


def align_to_spans(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Each symbol on every calendar date between its first and last bar."""
    features = [c for c in bars.columns if c not in ("symbol", "date")]
    rows = Window.partitionBy("symbol").orderBy("date_idx")
    side = measured_side(cal)
    if cal.limit(BLOCK_DATES + 1).count() > BLOCK_DATES:
        placed = bars.join(side, "date").drop("date")
        spans = placed.groupBy("symbol").agg(F.min("date_idx").alias("_lo"), F.max("date_idx").alias("_hi"))
        return _filled_by_blocks(placed, spans, features).join(side, "date_idx").select("symbol", "date", *features)
    own = F.col("date_idx") == F.col("_at")
    return (
        bars.join(side, "date")
        .withColumn("_to", F.coalesce(F.lead("date_idx").over(rows) - 1, F.col("date_idx")))
        .select("symbol", "date_idx", *features, F.explode(F.sequence("date_idx", "_to")).alias("_at"))
        .select("symbol", F.col("_at").alias("date_idx"), *[F.when(own, F.col(c)).alias(c) for c in features])
        .join(side, "date_idx")
        .select("symbol", "date", *features)
    )


def slice_dates(panel: Panel, start=None, end=None, end_inclusive: bool = True, drop_empty: bool = True) -> Panel:
    """Rows of a date range, clamped to the data; symbols without any value in the range are dropped.

    Ends outside the panel's calendar are told, where the panel knows it, without a job.
    """
    low, high = panel.first, panel.last
    if start is not None and low is not None and start < low:
        warnings.warn(f"start {start} is before the data, using {low}", stacklevel=2)
        start = low
    if end is not None and high is not None and end > high:
        warnings.warn(f"end {end} is after the data, using {high}", stacklevel=2)
        end = high
    out = panel.df
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end) if end_inclusive else F.col("date") < F.lit(end))
    if drop_empty:
        features = [c for c in out.columns if c not in ("symbol", "date", "date_idx")]
        present = F.greatest(*[F.col(c).isNotNull() for c in features]) if len(features) > 1 else F.col(features[0]).isNotNull()
        out = out.join(out.filter(present).select("symbol").distinct(), "symbol", "left_semi")
    return panel.over(out)


def slice_positions(panel: Panel, start: int, end: int, backtrack: int = 0, future: int = 0) -> Panel:
    """Calendar positions [start, end] widened by ``backtrack`` and ``future`` positions."""
    return panel.over(panel.df.filter(F.col("date_idx").between(start - backtrack, end + future)))


def recent(df: DataFrame, asof, days: int, offset: int = 0) -> DataFrame:
    day = F.lit(asof).cast("date")
    return df.filter(F.col("date").between(F.date_sub(day, days), F.date_sub(day, offset)))


def session_timestamp(df: DataFrame, offsets: dict[str, int], tz: str | None = None, name: str = "timestamp") -> DataFrame:
    """``date`` plus the offset (seconds) of the session, read in ``tz`` and given in UTC.

    An unknown session raises when the row is computed.
    """
    seconds = None
    for session, value in offsets.items():
        hit = F.col("session") == session
        seconds = F.when(hit, F.lit(value)) if seconds is None else seconds.when(hit, F.lit(value))
    unknown = F.raise_error(F.concat(F.lit("unknown session "), F.coalesce(F.col("session"), F.lit("NULL"))))
    stamp = F.col("date").cast("timestamp") + F.make_dt_interval(secs=seconds.otherwise(unknown.cast("int")))
    return df.withColumn(name, F.to_utc_timestamp(stamp, tz) if tz else stamp)


def resolve_features(df: DataFrame, wanted: Sequence[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Key columns plus the wanted features as DOUBLE; a feature without a column is all NULL."""
    aliases = aliases or ALIASES
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in wanted:
        found = [F.col(have[a]).cast("double") for a in aliases.get(f, [f]) if a in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("double")).alias(f))
    keys = [c for c in ("symbol", "date", "date_idx", "session", "timestamp") if c in df.columns]
    return df.select(*keys, *out)


def feature_name(text: str) -> str:
    """``FeatureType.Close``, ``$close`` or ``CLOSE`` -> ``close``."""
    name = text.strip().rsplit(".", 1)[-1].lstrip("$").lower()
    if name not in FEATURES:
        raise ValueError(f"unknown feature {text!r}")
    return name


def horizon_multiplier(df: DataFrame) -> DataFrame:
    """Mean number of sessions per (symbol, date), and the factor the forward horizon is scaled by."""
    # Two plain distinct steps instead of a distinct aggregate: a hot symbol is reduced map-side first.
    per_day = df.select("symbol", "date", "session").distinct().groupBy("symbol", "date").agg(F.count("session").alias("n"))
    return per_day.agg(F.avg("n").alias("sessions")).withColumn(
        "multiplier", F.when(F.col("sessions") > 1.5, F.round("sessions").cast("int")).otherwise(F.lit(1))
    )


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``; combines map-side, so repeated keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


# --- slow data -----------------------------------------------------------------------------------


def price_fundamental_join(prices: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Inner join on (symbol, date); both sides are unique on it, AQE picks the strategy."""
    return prices.join(fundamentals, ["symbol", "date"])


def symbol_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(symbol, side) with side ``common``, ``left`` or ``right``."""
    a = left.select("symbol").distinct().withColumn("_l", F.lit(1))
    b = right.select("symbol").distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("common")
    return a.join(b, "symbol", "full_outer").select("symbol", side.alias("side"))


def common_symbols(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = symbol_diff(left, right).filter(F.col("side") == "common").select("symbol")
    if shared.isEmpty():
        raise ValueError("the two tables share no symbol")
    return shared


def asof_fill(
    bars: DataFrame,
    slow: DataFrame,
    cols: Sequence[str],
    default: float | None = None,
    on: str = "date",
    group_rows: int | None = None,
) -> DataFrame:
    """The latest known slow value on or before each bar date, else ``default``.

    Both sides are stacked and carried forward by one window: a shuffle by symbol, no join. ``slow`` holds one
    row per (symbol, date). A symbol with more rows than one task should sort is cut into months; what the
    earlier months leave behind enters each month as one more slow row.
    """
    both = bars.select("symbol").unionByName(slow.select("symbol"))  # the window sorts the rows of both sides
    rows = max_group_rows(both, ["symbol"]) if group_rows is None else group_rows
    keys = ["symbol"]
    if rows > scale.MAX_GROUP_ROWS:
        keys = ["symbol", "_month"]
        bars, slow = (df.withColumn("_month", F.trunc(on, "month")) for df in (bars, slow))
        slow = slow.select("symbol", on, *cols, "_month").unionByName(_carried_in(bars, slow, cols, on))
    keep = [c for c in bars.columns if c != "_month"]
    left = bars.withColumn("_bar", F.lit(1))
    right = slow.select(*keys, on, *cols)
    stacked = left.select(*dict.fromkeys([*keep, *keys]), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in cols], "_bar").unionByName(
        right.withColumn("_bar", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(on, "_bar").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    if default is not None:
        filled = {c: F.coalesce(v, F.lit(default)) for c, v in filled.items()}
    return stacked.withColumns(filled).filter(F.col("_bar") == 1).select(*keep, *cols)


def _carried_in(bars: DataFrame, slow: DataFrame, cols: Sequence[str], on: str) -> DataFrame:
    """The last present slow values before each (symbol, month) of the bars, dated at the start of the month."""
    last = slow.groupBy("symbol", "_month").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(on))).alias(c) for c in cols])
    months = bars.select("symbol", "_month").distinct().join(last, ["symbol", "_month"], "full_outer")
    before = Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    return months.select(
        "symbol",
        F.col("_month").cast(slow.schema[on].dataType).alias(on),
        *[F.last(c, ignorenulls=True).over(before).alias(c) for c in cols],
        "_month",
    ).withColumn(on, F.date_sub(F.col(on), 1) if slow.schema[on].dataType == T.DateType() else F.col(on) - F.expr("INTERVAL 1 SECOND"))


def asof_lookup(df: DataFrame, day) -> DataFrame:
    """The last row of each symbol on or before ``day``."""
    rest = [c for c in df.columns if c != "symbol"]
    return (
        df.filter(F.col("date") <= F.lit(day).cast("date"))
        .groupBy("symbol")
        .agg(F.max_by(F.struct(*rest), "date").alias("_r"))
        .select("symbol", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


latest_rows = asof_lookup


def default_factors(symbols: DataFrame, factors: DataFrame, value: float = 1.0) -> DataFrame:
    """Factor rows, plus one of ``value`` at the IPO date for symbols that have none."""
    missing = symbols.join(factors.select("symbol").distinct(), "symbol", "left_anti")
    return factors.select("symbol", "date", "factor").unionByName(
        missing.select("symbol", F.col("ipo_date").alias("date"), F.lit(float(value)).alias("factor"))
    )


def readjust(bars: DataFrame, factors: DataFrame, reference_day) -> DataFrame:
    """Prices and factor relative to the factor known at ``reference_day``; volume the other way round."""
    prices = [c for c in ("open", "high", "low", "close", "preclose") if c in bars.columns]
    base = asof_lookup(factors, reference_day).select("symbol", F.col("factor").alias("_base"))
    daily = asof_fill(bars, factors, ["factor"], default=1.0)
    scaled = daily.join(base, "symbol", "left").withColumn("_base", F.coalesce("_base", F.lit(1.0)))
    scaled = scaled.withColumn("_f", F.col("factor") / F.col("_base"))
    return scaled.withColumns(
        {
            **{c: F.col(c) * F.col("_f") for c in prices},
            "volume": F.try_divide(F.col("volume"), F.col("_f")),
            "vwap": F.try_divide(F.col("amount"), F.try_divide(F.col("volume"), F.col("_f"))),
            "factor": F.col("_f"),
        }
    ).drop("_base", "_f")


def symbol_spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def roll_open_spans(spans: DataFrame, today) -> DataFrame:
    """Spans that end at the latest end are still open: they end today."""
    latest = spans.agg(F.max("end_date")).scalar()
    return spans.withColumn(
        "end_date", F.when(F.col("end_date") == latest, F.lit(today).cast("date")).otherwise(F.col("end_date"))
    )


def universe_members(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Bars inside a span of their symbol. A symbol may have several spans; a bar is kept once."""
    limits = spans.select("symbol", "start_date", "end_date")
    inside = F.col("date").between(F.col("start_date"), F.col("end_date"))
    return bars.alias("b").join(
        measured_side(limits).alias("s"), (F.col("b.symbol") == F.col("s.symbol")) & inside, "left_semi"
    )


def new_rows(incoming: DataFrame, spans: DataFrame, only_new_symbols: bool = False) -> DataFrame:
    """Incoming rows past each symbol's stored end; unknown symbols come whole."""
    joined = incoming.join(measured_side(spans.select("symbol", "end_date")), "symbol", "left")
    fresh = F.col("end_date").isNull()
    if not only_new_symbols:
        fresh = fresh | (F.col("date") > F.col("end_date"))
    return joined.filter(fresh).drop("end_date")


def merge_spans(stored: DataFrame, added: DataFrame) -> DataFrame:
    both = stored.select("symbol", "start_date", "end_date").unionByName(symbol_spans(added))
    return both.groupBy("symbol").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def derive_fundamentals(df: DataFrame) -> DataFrame:
    """Share counts from market cap for symbols that never report them, then turnover where it is missing."""
    reported = df.groupBy("symbol").agg(F.max(F.col("shares_outstanding").isNotNull()).alias("_has"))
    implied = F.when(F.col("market_cap") > 0, F.try_divide(F.col("market_cap"), F.col("close")))
    shares = F.when(F.col("_has"), F.col("shares_outstanding")).otherwise(implied)
    return (
        df.join(reported, "symbol")
        .withColumn("shares_outstanding", shares)
        .withColumn(
            "turnover",
            F.when(F.col("shares_outstanding") > 0, F.try_divide(F.col("volume"), F.col("shares_outstanding"))),
        )
        .drop("_has")
    )


# --- reshaping -----------------------------------------------------------------------------------


def sessions_to_long(wide: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Columns ending in ``_am`` / ``_pm`` (any case) become rows with a ``session``; one pass over the input."""
    by_session: dict[str, dict[str, str]] = {"AM": {}, "PM": {}}
    for c in wide.columns:
        suffix = c[-3:].upper()
        if c not in keys and suffix in ("_AM", "_PM"):
            by_session[suffix[1:]][c[:-3]] = c
    names = sorted(set(by_session["AM"]) | set(by_session["PM"]))
    types = {n: wide.schema[by_session["AM"].get(n) or by_session["PM"][n]].dataType for n in names}

    def packed(session: str) -> Column:
        cols = [
            (F.col(by_session[session][n]) if n in by_session[session] else F.lit(None)).cast(types[n]).alias(n) for n in names
        ]
        return F.struct(F.lit(session).alias("session"), *cols)

    return wide.select(*keys, F.explode(F.array(packed("AM"), packed("PM"))).alias("_s")).select(*keys, "_s.*")


def sessions_to_wide(long: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """One row per key with every value column twice (``_am``, ``_pm``); a single aggregate, no self join.

    (keys, session) is unique, so the maximum is the value.
    """
    values = [c for c in long.columns if c not in (*keys, "session")]
    aggs = [
        F.max(F.when(F.col("session") == s, F.col(c))).alias(f"{c}_{s.lower()}")
        for c in values
        for s in ("AM", "PM")
    ]
    return long.groupBy(*keys).agg(*aggs)


def benchmark_returns(bars: DataFrame, benchmarks: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """(date, session) with one ``ret_<benchmark>`` column each; duplicates are averaged."""
    r = bars.filter(F.col(symbol).isin(*benchmarks)).withColumn("_r", session_return(F.col("open"), F.col("close")))
    out = r.groupBy("date", "session").pivot(symbol, list(benchmarks)).agg(F.avg("_r"))
    return out.select("date", "session", *[F.col(b).alias(f"ret_{b}") for b in benchmarks])


def downcast(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def with_history(df: DataFrame, n: int, asof=None) -> DataFrame:
    """Rows (up to ``asof``) of the symbols that have at least ``n`` of them."""
    rows = df if asof is None else df.filter(F.col("date") <= F.lit(asof).cast("date"))
    enough = rows.groupBy("symbol").count().filter(F.col("count") >= n).select("symbol")
    return rows.join(enough, "symbol", "left_semi")


def raw_kline(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Text fields to DOUBLE, blanks as 0."""
    return df.withColumns({c: F.when(F.trim(c) == "", F.lit("0")).otherwise(F.trim(c)).cast("double") for c in fields})
