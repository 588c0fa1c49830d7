"""Live bars with Structured Streaming; the same functions run on batch frames."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.panel import densify
from ..operators.portfolio import factor_score
from ..operators.scale import measured_side
from ..plans.evaluate import add_factors
from ..session import ship
from ..plans.formula import DEFAULT, FormulaOptions, parse, reach

_FIELDS = ("open", "high", "low", "close", "volume", "vwap")
HISTORY_BUCKETS = 2_048  # groups of symbols that share a state
LATENESS = "5 days"  # fixed value: how long an open day waits for late bars


def _bars(minute: DataFrame, length: str, ts: str, lateness: str, start: str | None, zone: str | None) -> DataFrame:
    """Per-symbol bars of fixed length. A window closes when the watermark passes it; later rows are dropped.

    Times are moved to the clock of ``zone`` (the session's by default) before anything else, so windows start at local
    midnight on both sides of a change of daylight saving; ``start`` (``"5 hours"``) moves them to where the trading day starts.
    """
    session_zone = minute.sparkSession.conf.get("spark.sql.session.timeZone")
    plain = minute.schema[ts].dataType.simpleString() == "timestamp_ntz"  # already a clock's time
    moved = minute.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), session_zone if plain else zone or session_zone))
    rows = moved.withWatermark(ts, lateness) if minute.isStreaming else moved
    return (
        rows.groupBy(F.window(ts, length, startTime=start), "symbol")
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.sum("volume").alias("volume"),
            F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap"),
        )
        .filter(F.col("volume") > 0)
    )


def _day() -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86_400).cast("int"))


def daily_bars(minute: DataFrame, ts: str = "datetime", lateness: str = LATENESS, start: str | None = None, zone: str | None = None) -> DataFrame:
    out = _bars(minute, "1 day", ts, lateness, start, zone)
    return out.select("symbol", _day().alias("date"), "open", "high", "low", "close", "volume", "vwap")


def session_bars(minute: DataFrame, ts: str = "datetime", lateness: str = LATENESS, start: str | None = None, zone: str | None = None) -> DataFrame:
    out = _bars(minute, "12 hours", ts, lateness, start, zone)
    session = F.when(F.pmod(F.unix_seconds("window.start"), F.lit(86_400)) < 43_200, "AM").otherwise("PM")
    return out.select(
        "symbol", _day().alias("date"), session.alias("session"), "open", "high", "low", "close", "volume", "vwap"
    )


def bounded_history(daily: DataFrame, n: int, min_rows: int = 40, idle_days: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """Per symbol and batch: the last ``n`` daily bars known, oldest first, and whether they are enough.

    The state holds these bars, so it stays small however long the stream runs. With ``idle_days`` a symbol is
    forgotten once the watermark (the newest date less ``lateness``) has passed its newest bar by more than so many days; a row
    with no bars tells so, and a later bar starts its history anew. Bars up to the watermark come too late and are left out.

    Symbols share the state of their bucket, one of ``HISTORY_BUCKETS`` by hash: Python is called once a bucket, not once a symbol.
    """

    width = len(_FIELDS)

    def update(key, frames, state: GroupState):
        symbols, sizes, dates, values, deadlines = _held(state, width)
        touched: set[int] = set()
        place = {s: i for i, s in enumerate(symbols)}
        now = state.getCurrentWatermarkMs() if idle_days is not None else None
        for pdf in () if state.hasTimedOut else frames:
            new, names = pd.factorize(pdf["symbol"], use_na_sentinel=False)
            names = [None if pd.isna(s) else s for s in names.tolist()]
            for s in names:
                if s not in place:
                    place[s] = len(symbols)
                    symbols.append(s)
            at = np.array([place[s] for s in names], dtype=np.int64)
            touched.update(at.tolist())
            # Of equal dates the last row counts, and each symbol keeps its n newest.
            code = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), at[new]])
            dates = np.concatenate([dates, pdf["date"].astype(str).to_numpy().astype(str)])
            values = np.concatenate([values, pdf[list(_FIELDS)].astype(float).to_numpy()])
            order = np.lexsort((dates, code))
            code, dates, values = code[order], dates[order], values[order]
            keep = np.append((code[1:] != code[:-1]) | (dates[1:] != dates[:-1]), True)
            code, dates, values = code[keep], dates[keep], values[keep]
            sizes = np.bincount(code, minlength=len(symbols))
            keep = np.cumsum(sizes)[code] - np.arange(len(code)) <= n
            dates, values, sizes = dates[keep], values[keep], np.minimum(sizes, n)
        last = dates[np.cumsum(sizes) - 1]
        seen = np.zeros(len(symbols), bool)
        seen[list(touched)] = True
        gone = np.zeros(len(symbols), bool)
        if idle_days is not None:
            idle = last.astype("datetime64[ms]").astype(np.int64) + idle_days * 86_400_000
            deadlines = np.where(seen, np.maximum(idle, now + 1), np.append(deadlines, np.zeros(len(symbols) - len(deadlines), np.int64)))
            gone = ~seen & (deadlines < now)
        ends = np.cumsum(sizes)
        told = np.flatnonzero(seen | gone)
        bars = np.where(gone, 0, sizes)[told]
        yield pd.DataFrame({
            "symbol": pd.Series([symbols[i] for i in told], dtype=object), "bars": bars, "last_date": last[told].astype(object), "enough": ~gone[told] & (bars >= min_rows),
            "dates": pd.Series([dates[ends[i] - b : ends[i]].tolist() for i, b in zip(told, bars, strict=True)], dtype=object),
            "values": pd.Series([values[ends[i] - b : ends[i]].ravel() for i, b in zip(told, bars, strict=True)], dtype=object),
        })
        rows = np.repeat(~gone, sizes)
        if gone.all():
            state.remove()
            return
        left = np.flatnonzero(~gone)
        deadlines = deadlines[left] if idle_days is not None else np.zeros(0, np.int64)
        state.update(([symbols[i] for i in left], sizes[left].astype(np.int64).tobytes(), dates[rows].tolist(), values[rows].tobytes(), deadlines.tobytes()))
        if idle_days is not None:
            state.setTimeoutTimestamp(max(int(deadlines.min()), now + 1))

    ship(daily.sparkSession)
    symbol = daily.schema["symbol"].dataType.simpleString()
    bucket = F.when(F.col("symbol").isNotNull(), F.pmod(F.xxhash64("symbol"), F.lit(HISTORY_BUCKETS))).otherwise(-1).cast("int")
    rows = daily.select(bucket.alias("_bucket"), "symbol", "date", *_FIELDS)
    if idle_days is not None:
        midnight = F.timestamp_seconds(F.unix_date("date").cast("long") * 86_400)  # of UTC, as the time-outs are
        rows = rows.withColumn("_t", midnight).withWatermark("_t", lateness)
    out = rows.groupBy("_bucket").applyInPandasWithState(
        update,
        f"symbol {symbol}, bars long, last_date string, enough boolean, dates array<string>, values array<double>",
        f"symbols array<{symbol}>, sizes binary, dates array<string>, values binary, deadlines binary",
        "append",
        GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.EventTimeTimeout,
    )

    def bar(date: Column, i: Column) -> Column:
        at = [F.get("values", i * width + k) for k in range(width)]
        return F.struct(date.alias("date"), *[F.when(~F.isnan(v), v).alias(f) for f, v in zip(_FIELDS, at, strict=True)])

    return out.select("symbol", "bars", "last_date", "enough", F.transform("dates", bar).alias("history"))


def _held(state: GroupState, width: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their numbers of bars, dates, values (bars x width) and time-outs of a bucket."""
    symbols, sizes, dates, values, deadlines = state.get if state.exists else ([], b"", [], b"", b"")
    dates = np.array(dates, dtype=str) if len(dates) else np.zeros(0, "U10")
    return list(symbols), np.frombuffer(sizes, np.int64), dates, np.frombuffer(values).reshape(-1, width), np.frombuffer(deadlines, np.int64)


def score_new_bars(
    spark: SparkSession, new: DataFrame, store: str, scores: str, pool: Mapping[str, float], options: FormulaOptions = DEFAULT
) -> None:
    """``foreachBatch`` body: append new bars to the store, score the dates they bring, append the scores.

    Formulas see only as many stored dates as they reach back; a batch replayed after a failure first drops the
    rows it already wrote, so nothing is scored twice.
    """
    span = new.agg(F.min("date"), F.max("date")).first()
    if span[0] is None:
        return
    _append_once(spark, new, store, span)
    back = max(reach(parse(f, options))[0] for f in pool)
    bars = spark.read.parquet(store)
    earlier = bars.filter(F.col("date") < F.lit(span[0])).select("date").distinct().orderBy(F.col("date").desc()).limit(back)
    start = earlier.agg(F.min("date")).first()[0] or span[0]
    # The date filters reach the scan, so only the lookback is read from the store.
    panel = densify(bars.filter(F.col("date").between(F.lit(start), F.lit(span[1]))))
    names = {f"_a{i}": f for i, f in enumerate(pool)}
    scored = factor_score(add_factors(panel, names, options), {n: pool[f] for n, f in names.items()})
    fresh = scored.df.join(measured_side(new.select("date").distinct()), "date", "left_semi")
    _append_once(spark, fresh.select("symbol", "date", "score"), scores, span)


def _append_once(spark: SparkSession, rows: DataFrame, path: str, span) -> None:
    """Append the rows whose (symbol, date) is not stored yet; only the stored dates of the span are looked at.

    The store has a folder per date, so the span and the lookback of later batches are lists of folders.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        have = spark.read.parquet(path).filter(F.col("date").between(F.lit(span[0]), F.lit(span[1])))
        rows = rows.join(have.select("symbol", "date"), ["symbol", "date"], "left_anti")
    rows.write.mode("append").partitionBy("date").parquet(path)


def with_monthly_factors(daily: DataFrame, months: DataFrame) -> DataFrame:
    """Bars with the factor set of their month (``months``: portfolio.factor_sets_as_of output).

    A stream-static join: the few monthly rows are read again for every micro-batch.
    """
    sets = months.select(F.date_format("month", "yyyy_MM").alias("_m"), "exprs", "weights")
    return daily.withColumn("_m", F.date_format("date", "yyyy_MM")).join(sets, "_m", "left").drop("_m")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

