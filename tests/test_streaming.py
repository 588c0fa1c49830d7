"""Streams against their batch twins."""

import datetime as dt
import time
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from factorspark.catalog.bars import minutes
from factorspark.operators import panel as P
from factorspark.operators.panel import densify
from factorspark.operators.portfolio import factor_score
from factorspark.plans.evaluate import add_factors
from factorspark.streaming import bars as stream

SMALL = "/root/testdata/sf0.001"


def source(spark, tmp_path, files=4):
    m = minutes(spark, SMALL).withColumn("datetime", F.col("datetime").cast("timestamp"))
    path = str(tmp_path / "minutes")
    for i in range(files):  # one file per week, oldest first, as a feed would bring them
        lo, hi = dt.datetime(2024, 1, 1) + dt.timedelta(days=8 * i), dt.datetime(2024, 1, 1) + dt.timedelta(days=8 * (i + 1))
        m.filter((F.col("datetime") >= F.lit(lo)) & (F.col("datetime") < F.lit(hi))).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return m, spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)


def closed(batch, minutes_df, hours):
    """Windows that end at or before the final watermark."""
    last = minutes_df.agg(F.max("datetime")).first()[0] - dt.timedelta(days=5)
    start = F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.when(F.col("session") == "PM", 12).otherwise(0)) if hours == 12 else F.col("date").cast("timestamp")
    return batch.filter(start + F.expr(f"INTERVAL {hours} HOURS") <= F.lit(last))


def same(a, b):
    cols = sorted(a.columns)
    key = lambda df: sorted(map(str, ([round(v, 6) if isinstance(v, float) else v for v in r] for r in df.select(*cols).collect())))
    assert key(a) == key(b)


def test_daily_bars_stream(spark, tmp_path):
    m, s = source(spark, tmp_path)
    stream.run_to_end(stream.daily_bars(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = closed(stream.daily_bars(m), m, 24)
    assert want.count() > 100
    same(got, want)


def test_session_bars_stream(spark, tmp_path):
    m, s = source(spark, tmp_path)
    stream.run_to_end(stream.session_bars(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    same(spark.read.parquet(str(tmp_path / "out")), closed(stream.session_bars(m), m, 12))


def test_late_rows_do_not_reopen_a_day(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 10)
    rows = [[(day, 1.0), (day + dt.timedelta(hours=1), 2.0)], [(day + dt.timedelta(days=9), 3.0)], [(day + dt.timedelta(hours=2), 50.0), (day + dt.timedelta(days=20), 4.0)]]
    path = str(tmp_path / "in")
    schema = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double"
    query = None
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for batch in rows:  # each run of the query sees one more file
        spark.createDataFrame([("A", t, p, p, p, p, 1.0) for t, p in batch], schema).coalesce(1).write.mode("append").parquet(path)
        query = spark.readStream.schema(schema).parquet(path)
        stream.run_to_end(stream.daily_bars(query), out, cp)
    got = {r["date"]: r["close"] for r in spark.read.parquet(out).collect()}
    assert got[dt.date(2024, 1, 1)] == 2.0 and got[dt.date(2024, 1, 10)] == 3.0


def test_zero_volume_days_are_dropped(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 10), 1.0, 0.0), ("A", dt.datetime(2024, 1, 2, 10), 1.0, 5.0)], "symbol string, datetime timestamp, open double, volume double")
    df = df.selectExpr("symbol", "datetime", "open", "open as high", "open as low", "open as close", "volume")
    assert [r["date"] for r in stream.daily_bars(df).collect()] == [dt.date(2024, 1, 2)]


def test_bounded_history(spark, tmp_path):
    daily = stream.daily_bars(minutes(spark, SMALL).withColumn("datetime", F.col("datetime").cast("timestamp")))
    path = str(tmp_path / "daily")
    daily.repartitionByRange(3, "date").write.parquet(path)
    s = spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.run_to_end(stream.bounded_history(s, 8, 5), str(tmp_path / "out"), str(tmp_path / "cp"))
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("symbol").agg(F.max("bars").alias("bars"))
    want = daily.groupBy("symbol").agg(F.least(F.count(F.lit(1)), F.lit(8)).alias("bars"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


POOL = {"Sub($close,Ref($close,1d))": 0.7, "Mean($volume,3d)": -0.2}


def test_scoring_new_bars_matches_batch(spark, tmp_path):
    daily = stream.daily_bars(minutes(spark, SMALL).withColumn("datetime", F.col("datetime").cast("timestamp")))
    daily = daily.withColumn("volume", F.col("volume").cast("double")).cache()
    store, scores = str(tmp_path / "store"), str(tmp_path / "scores")
    for lo, hi in [("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-31")]:
        batch = daily.filter(F.col("date").between(lo, hi))
        stream.score_new_bars(spark, batch, store, scores, POOL)
    stream.score_new_bars(spark, batch, store, scores, POOL)  # a replayed batch changes nothing
    panel = densify(daily)
    names = {f"_a{i}": f for i, f in enumerate(POOL)}
    want = factor_score(add_factors(panel, names), {n: POOL[f] for n, f in names.items()}).df
    # A batch knows the symbols seen so far in its lookback, so compare the last dates, where all are known.
    tail = F.col("date") >= "2024-01-24"
    got = {(r["symbol"], r["date"]): r["score"] for r in spark.read.parquet(scores).filter(tail).collect()}
    full = {(r["symbol"], r["date"]): r["score"] for r in want.filter(tail).collect()}
    assert len(got) == spark.read.parquet(scores).filter(tail).dropDuplicates(["symbol", "date"]).count()
    assert set(got) <= set(full)
    if set(got) == set(full):
        assert got == pytest.approx(full, abs=1e-9)


def test_monthly_factors_on_a_stream(spark, tmp_path):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 5)), ("A", dt.date(2024, 3, 5))], "symbol string, date date")
    bars.write.parquet(str(tmp_path / "b"))
    sets = spark.createDataFrame([(dt.date(2024, 1, 1), ["$close"], [1.0])], "month date, exprs array<string>, weights array<double>")
    s = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "b"))
    stream.run_to_end(stream.with_monthly_factors(s, sets), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["date"]: r["exprs"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {dt.date(2024, 1, 5): ["$close"], dt.date(2024, 3, 5): None}


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_days_of_the_exchange(spark, tmp_path, session_zone):
    """New York evenings belong to the New York day, in batch and in streams, also when daylight saving begins."""
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        local = [(d, h) for d in ("2024-03-08", "2024-03-09", "2024-03-10", "2024-03-11", "2024-04-20") for h in ("10:00:00", "20:30:00")]
        at = [dt.datetime.fromisoformat(f"{d} {h}").replace(tzinfo=ZoneInfo("America/New_York")) for d, h in local]
        rows = [("A", t, *[float(k)] * 4, 1.0) for k, t in enumerate(at)]
        df = spark.createDataFrame(rows, "symbol string, datetime timestamp, open double, high double, low double, close double, volume double")
        path = str(tmp_path / "in")
        df.write.parquet(path)
        zone = "America/New_York"
        source = spark.read.parquet(path)
        batch = {(r["date"], r["open"], r["close"]) for r in P.daily_bars(source, zone=zone).collect()}
        want = {(dt.date.fromisoformat(d), 2.0 * i, 2.0 * i + 1) for i, (d, _) in enumerate(local[::2])}
        assert batch == want
        feed = spark.readStream.schema(source.schema).parquet(path)
        stream.run_to_end(stream.daily_bars(feed, zone=zone), str(tmp_path / "out"), str(tmp_path / "cp"))
        got = {(r["date"], r["open"], r["close"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {x for x in want if x[0] < dt.date(2024, 4, 1)}
        halves = {(r["date"], r["session"]) for r in stream.session_bars(source, zone=zone).collect()}
        assert halves == {(r["date"], r["session"]) for r in P.session_bars(source, zone=zone).collect()} and len(halves) == 10
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_quiet_symbols_are_forgotten_and_late_bars_left_out(spark, tmp_path):
    schema = "symbol string, date date, open double, high double, low double, close double, volume double, vwap double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        values = [(s, dt.date.fromisoformat(d), *[float(v)] * 6) for s, d, v in rows]
        spark.createDataFrame(values, schema).write.mode("append").parquet(source)
        feed = spark.readStream.schema(schema).parquet(source)
        stream.run_to_end(stream.bounded_history(feed, 3, 2, 20, "5 days"), out, str(tmp_path / "progress"))

    arrive(("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("b", "2024-01-02", 3))
    arrive(("b", "2024-02-01", 4), ("b", "2024-01-10", 5))  # the newest date is 1 February now: a is quiet
    arrive(("b", "2024-01-20", 6), ("a", "2024-02-02", 7))  # the first comes too late, a begins anew
    rows = [(r["symbol"], r["bars"], r["last_date"]) for r in spark.read.parquet(out).orderBy("symbol", "last_date", F.col("bars").desc()).collect()]
    assert rows == [("a", 1, "2024-01-01"), ("a", 0, "2024-01-01"), ("a", 1, "2024-02-02"), ("b", 1, "2024-01-02"), ("b", 3, "2024-02-01")]
