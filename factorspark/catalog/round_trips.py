"""Queries that write with one of the library's sinks and read back what was written, and small look-ups."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import windows as T
from ..operators.panel import densify
from ..operators.portfolio import ranked
from ..operators.scale import spread
from ..plans.evaluate import factor_table
from ..plans.formula import FormulaOptions
from ..session import shared_folder, ship
from ..sources import bars as B
from ..sources import store as S
from .bars import DAILY_SQL, daily
from .base import q6, query, r6, table
from .fixtures import BARS_SQL, FORWARD, PANEL_SQL, POOL, bars, panel
from .metrics import SCORES_SQL, WINDOWS_SQL, rolling


@query(
    "window_lookup",
    f"""WITH {PANEL_SQL}, {WINDOWS_SQL}, w AS (SELECT 'month' AS found, * FROM windows WHERE deploy_month = '1997_01' UNION ALL SELECT 'index', * FROM windows WHERE window_idx = 7)
SELECT found, window_idx, count(close) AS closes FROM w JOIN panel ON date BETWEEN train_start AND train_end GROUP BY 1, 2""",
)
def window_lookup(spark, folder):
    """Bars of the training windows found by month and by number."""
    w, p = rolling(spark), panel(spark, folder).df
    parts = {"month": T.window_of_month(w, "1997-01"), "index": T.window_of_index(w, 7)}
    out = None
    for name, found in parts.items():
        rows = T.in_windows(p, found, "train_start", "train_end", "window_idx").groupBy("window_idx").agg(F.count("close").alias("closes"))
        rows = rows.select(F.lit(name).alias("found"), "window_idx", "closes")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("any_column", f"WITH {DAILY_SQL} SELECT symbol, date, {q6('(amount - volume) / nullif(close, 0)')} AS value FROM daily")
def any_column(spark, folder):
    """A formula over a column that is no named feature."""
    p = densify(daily(spark, folder))
    out = factor_table(p, {"value": "Div(Sub($amount,$volume),$close)"}, FormulaOptions(features=None))
    own = p.df.filter(F.col("close").isNotNull()).select("symbol", "date")
    return out.join(own, ["symbol", "date"]).select("symbol", "date", r6("value").alias("value"))


RANKED_SQL = f"{BARS_SQL}, r AS (SELECT symbol, close, row_number() OVER (ORDER BY close DESC, symbol) AS rank FROM bars WHERE date = DATE '1997-03-01')"


@query(
    "ranked_sink",
    f"""WITH {RANKED_SQL}, parts AS (SELECT 'all' AS part, * FROM r UNION ALL SELECT 'top', * FROM r WHERE rank <= 10
UNION ALL SELECT 'bottom', * FROM r WHERE rank > (SELECT count(*) FROM r) - 5) SELECT part, symbol, {q6("close")} AS close, rank FROM parts""",
)
def ranked_sink(spark, folder):
    month = bars(spark, folder).filter("date = DATE '1997-03-01'")
    path = shared_folder(spark, "ranked")
    S.write_ranked(ranked(month, "close").select("symbol", "close", "rank"), path, 10, 5)
    read = spark.read.option("header", "true").schema("symbol long, close double, rank long")
    parts = [read.csv(f"{path}/{part}").select(F.lit(part).alias("part"), "symbol", r6("close").alias("close"), "rank") for part in ("all", "top", "bottom")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("metric_log", f"WITH {BARS_SQL} SELECT year(date) AS step, count(*) AS n, {q6('sum(close)')} AS total FROM bars GROUP BY 1")
def metric_log(spark, folder):
    """A log that grows by appended rows, one append for odd and one for even years."""
    path = shared_folder(spark, "metrics")
    rows = bars(spark, folder).groupBy(F.year("date").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))
    for parity in (0, 1):
        S.append_metrics(rows.filter(F.col("step") % 2 == parity), path)
    log = spark.read.schema("step long, n long, total double").json(path)
    return log.select("step", "n", r6("total").alias("total"))


@query(
    "exports",
    f"WITH {BARS_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS format, symbol, count(*) AS n, {q6('sum(close)')} AS total FROM bars GROUP BY 2" for f in ("parquet", "csv", "per_symbol")),
)
def exports(spark, folder):
    path = shared_folder(spark, "exports")
    S.export(bars(spark, folder).select("symbol", "date", "close"), path, ("parquet", "csv", "per_symbol_csv"))
    text = spark.read.option("header", "true").schema("symbol long, date date, close double")
    read = {"parquet": spark.read.parquet(f"{path}/parquet"), "csv": text.csv(f"{path}/csv"), "per_symbol": text.option("recursiveFileLookup", "true").csv(f"{path}/per_symbol")}
    out = None
    for name, df in read.items():
        rows = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("close")).alias("total")).select(F.lit(name).alias("format"), "symbol", "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("round_scores", f"WITH {SCORES_SQL}, o AS (SELECT * FROM (VALUES {', '.join(f'({i % 2}, {chr(39)}{f}{chr(39)})' for i, f in enumerate(POOL))}) t(round, expr)) SELECT round, expr, {q6('ic')} AS ic FROM o JOIN scores USING (expr)")
def round_scores(spark, folder):
    """Two rounds of candidates, gathered by the hook that is called after each."""
    formulas, found = list(POOL), []
    M.score_rounds(panel(spark, folder), [formulas[::2], formulas[1::2]], FORWARD, lambda k, df: found.append(df.select(F.lit(k).cast("long").alias("round"), "expr", r6("ic").alias("ic"))))
    return found[0].unionByName(found[1])


def _write_zips(rows, keys, folder: str, name, member) -> None:
    """One archive per group, in the store that the folder's address names; ``name`` and ``member`` make the paths from the group's keys.

    Spark makes the text of each group; a task writes the archives of all its groups.
    """
    ship(rows.sparkSession)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c not in keys])
    texts = spread(rows, *keys).groupBy(*keys).agg(F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("text"))

    def write(batches):
        store, root = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        made = set()
        for batch in batches:
            *groups, text = (c.to_pylist() for c in batch.columns)
            for key, body in zip(zip(*groups, strict=True), text, strict=True):
                path = f"{root}/{name(*key)}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(member(*key), body + "\n")
                with store.open_output_stream(path) as f:
                    f.write(data.getvalue())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    texts.mapInArrow(write, "n long").agg(F.sum("n")).collect()


MINUTE_SQL = """ticks AS (SELECT 'U' || user_id AS symbol, date_trunc('milliseconds', ts) AS datetime, CAST(ts AS DATE) AS date, value AS price, CAST(props->>'k' AS DOUBLE) AS volume FROM events)"""


@query("minute_zip_scan", f"WITH {MINUTE_SQL} SELECT symbol, datetime, {q6('price')} AS close, volume FROM ticks WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND length(symbol) = 2")
def minute_zip_scan(spark, folder):
    """Trades as one archive for each user and day, of which the scan opens those of some users and days."""
    path = shared_folder(spark, "minutes")
    e = table(spark, folder, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.to_date("ts").cast("timestamp"))
    price = F.round(F.col("value") * 10_000).cast("long")
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), F.date_format("ts", "yyyyMMdd").alias("day"), ms.alias("ms"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )
    _write_zips(rows, ["symbol", "day"], path, lambda symbol, day: f"{symbol}/{day}_trade.zip", lambda symbol, day: f"{day}_{symbol}_minute_trade.csv")
    got = B.read_minute_zips(spark, path, [f"u{k}" for k in range(10)], "2024-01-08", "2024-01-12")
    return got.select("symbol", F.col("datetime").cast("timestamp_ntz").alias("datetime"), r6("close").alias("close"), "volume")


@query("daily_zip_scan", f"WITH {DAILY_SQL} SELECT 'U' || symbol AS symbol, date, {q6('round(close * 10000) / 10000')} AS close, volume FROM daily WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def daily_zip_scan(spark, folder):
    """Daily bars as one archive for each user."""
    path = shared_folder(spark, "days")
    fields = [F.round(F.col(c) * 10_000).cast("long").alias(c) for c in ("open", "high", "low", "close")]
    rows = daily(spark, folder).select(F.concat(F.lit("u"), F.col("symbol").cast("string")).alias("symbol"), F.date_format("date", "yyyyMMdd").alias("d"), *fields, "volume")
    _write_zips(rows, ["symbol"], path, lambda symbol: f"{symbol}.zip", lambda symbol: f"{symbol}.csv")
    return B.read_daily_zips(spark, path, start="2024-01-05", end="2024-01-20").select("symbol", "date", r6("close").alias("close"), "volume")
