"""Stores and streams that start from the given tables and run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import style as Y
from ..session import shared_folder
from ..sources import store as S
from ..streaming import bars as stream
from .bars import BENCH, DAILY_SQL, minutes, rounded, rounded_sql
from .base import q6, query, r6, table
from .fixtures import SESSION_SQL, session


@query("store_round_trip", f"WITH {SESSION_SQL} SELECT symbol, date, session, close, volume FROM session WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'")
def store_round_trip(spark, folder):
    path = shared_folder(spark, "store")
    S.write_store(session(spark, folder), path)
    out = S.read_store(spark, path, "2024-01-03", "2024-01-28", ["close", "vol*"])
    return out.select("symbol", "date", "session", "close", "volume")


@query(
    "feature_store_build",
    f"""WITH {SESSION_SQL}, d AS (SELECT date, count(DISTINCT symbol) AS n FROM session GROUP BY 1)
SELECT d.date, s.session, any_value(d.n) AS rows, count(x.close) AS closes FROM d CROSS JOIN (VALUES ('AM'), ('PM')) s(session)
LEFT JOIN session x ON x.date = d.date AND x.session = s.session GROUP BY 1, 2""",
)
def feature_store_build(spark, folder):
    path = shared_folder(spark, "features")
    t = minutes(spark, folder)
    kinds = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("datetime"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )
    Y.build_feature_store(t, path, BENCH, [4], benchmark_minute=kinds)
    stored = S.read_store(spark, path, "2024-01-01", "2024-12-31")
    return stored.groupBy("date", "session").agg(F.count(F.lit(1)).alias("rows"), F.count("close").alias("closes"))


def trade_stream(spark, folder):
    """The events table as a file stream of one-trade bars."""
    schema = table(spark, folder, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return e.select(
        F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("datetime"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )


# A day is emitted once the watermark, five days behind the newest event, has passed its end.
CLOSED = "date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 5 DAY"


@query("stream_run", f"WITH {DAILY_SQL} SELECT symbol, date, {rounded_sql()} FROM daily WHERE volume > 0 AND {CLOSED}")
def stream_run(spark, folder):
    out = shared_folder(spark, "stream-bars")
    stream.run_to_end(stream.daily_bars(trade_stream(spark, folder)), out, f"{out}-progress")
    got = spark.read.parquet(out).withColumn("volume", F.col("volume").cast("double"))
    return rounded(got, "symbol", "date")


LIVE_POOL = {"Sub($close,Ref($close,1d))": 0.7, "Mean($volume,3d)": -0.2}


@query(
    "stream_scores",
    f"""WITH {DAILY_SQL}, closed AS (SELECT symbol, date, close, volume FROM daily WHERE volume > 0 AND {CLOSED}),
dense AS (SELECT s.symbol, c.date, d.close, d.volume FROM (SELECT DISTINCT date FROM closed) c CROSS JOIN (SELECT DISTINCT symbol FROM closed) s LEFT JOIN closed d ON d.symbol = s.symbol AND d.date = c.date),
f AS (SELECT symbol, date, close - lag(close, 1) OVER s AS a, CASE WHEN count(volume) OVER w = 3 THEN avg(volume) OVER w END AS b FROM dense
  WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
z AS (SELECT symbol, date, a, b, {', '.join(f"coalesce(CASE WHEN count({c}) OVER d >= 2 AND stddev_pop({c}) OVER d >= 1e-8 THEN ({c} - avg({c}) OVER d) / stddev_pop({c}) OVER d END, 0) AS z{c}" for c in 'ab')} FROM f WINDOW d AS (PARTITION BY date))
SELECT symbol, date, {q6('CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 0.7 * za - 0.2 * zb END')} AS score FROM z""",
)
def stream_scores(spark, folder):
    """Closed days reach the scorer through ``foreachBatch``; it keeps its own store and appends the scores."""
    base = shared_folder(spark, "stream-scores")
    daily = stream.daily_bars(trade_stream(spark, folder))

    def score(batch, _):
        batch = batch.withColumn("volume", F.col("volume").cast("double"))
        stream.score_new_bars(batch.sparkSession, batch, f"{base}/bars", f"{base}/scores", LIVE_POOL)

    run = daily.writeStream.outputMode("append").foreachBatch(score).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    run.start().awaitTermination()
    return spark.read.parquet(f"{base}/scores").select("symbol", "date", r6("score").alias("score"))


@query(
    "stream_history",
    f"""WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM daily WHERE volume > 0)
SELECT symbol, date, least(n, 12) AS bars, n >= 10 AS enough, {rounded_sql()} FROM r WHERE r <= 12""",
)
def stream_history(spark, folder):
    """The bars kept of each symbol after all daily bars have arrived."""
    source, out = shared_folder(spark, "daily"), shared_folder(spark, "history")
    daily = stream.daily_bars(minutes(spark, folder).withColumn("datetime", F.col("datetime").cast("timestamp")))
    daily.write.parquet(source)
    feed = spark.readStream.schema(daily.schema).parquet(source)
    stream.run_to_end(stream.bounded_history(feed, 12, 10), out, f"{out}-progress")
    last = spark.read.parquet(out).groupBy("symbol").agg(F.max_by(F.struct("bars", "enough", "history"), F.struct("last_date", "bars")).alias("_r"))
    kept = last.select("symbol", "_r.bars", "_r.enough", F.explode("_r.history").alias("_b")).select("symbol", "bars", "enough", "_b.*")
    return rounded(kept.withColumn("date", F.to_date("date")), "symbol", "date", "bars", "enough")


# Orders as daily bars of customers. They arrive in four parts; one in fifty comes a part late.
PART = "least(3, year(o_orderdate) // 2 - 997 + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END)"
SEGMENT_SQL = f"""o AS (SELECT o_custkey AS symbol, o_orderdate::DATE AS date, {PART} AS part FROM orders),
marks AS (SELECT p.part, (SELECT max(date) FROM o WHERE o.part < p.part) - 30 AS mark FROM (SELECT unnest(range(5)) AS part) p),
seen AS (SELECT o.* FROM o JOIN marks USING (part) WHERE mark IS NULL OR date > mark),
steps AS (SELECT symbol, part, max(max(date)) OVER s AS newest, lead(part, 1, 4) OVER s AS next FROM seen GROUP BY 1, 2 WINDOW s AS (PARTITION BY symbol ORDER BY part)),
ends AS (SELECT symbol, steps.part, newest, mark > newest + 400 AS gone FROM steps JOIN marks ON marks.part = next),
spans AS (SELECT *, coalesce(sum(gone::INT) OVER (PARTITION BY symbol ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM ends)"""


@query(
    "stream_eviction",
    f"""WITH {SEGMENT_SQL} SELECT symbol, max(newest) AS last_date, least(12, count(DISTINCT date)) AS bars, bool_or(gone) AS forgotten
FROM spans JOIN seen USING (symbol, part) GROUP BY symbol, span""",
)
def stream_eviction(spark, folder):
    """Histories of customers from files that arrive one after another, some rows too late; quiet customers are forgotten."""
    source, out = shared_folder(spark, "arrivals"), shared_folder(spark, "histories")
    late = F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), *[F.col("o_totalprice").alias(c) for c in ("open", "high", "low", "close", "vwap")], F.lit(1.0).alias("volume"),
        F.least(F.lit(3), F.floor(F.year("o_orderdate") / 2) - 997 + late).alias("part"),
    )
    for part in range(4):
        o.filter(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        feed = spark.readStream.schema(o.drop("part").schema).parquet(source)
        stream.run_to_end(stream.bounded_history(feed, 12, 10, 400, "30 days"), out, f"{out}-progress")
    rows = spark.read.parquet(out).groupBy("symbol", "last_date").agg(F.max("bars").alias("bars"), F.bool_or(F.col("bars") == 0).alias("forgotten"))
    newest = Window.partitionBy("symbol")
    ended = rows.withColumn("_newest", F.max("last_date").over(newest)).filter(F.col("forgotten") | (F.col("last_date") == F.col("_newest")))
    return ended.select("symbol", F.to_date("last_date").alias("last_date"), "bars", "forgotten")
