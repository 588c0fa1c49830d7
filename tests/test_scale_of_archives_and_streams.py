"""Archives by the thousand and streams of many symbols."""

import datetime as dt
import zipfile

import numpy as np
from pyspark.sql import functions as F

from factorspark.catalog import round_trips
from factorspark.sources import bars as B
from factorspark.streaming import bars as stream


def zipped(at, name, rows=1):
    at.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(at / f"{name}_trade.zip", "w") as z:
        z.writestr("only.csv", "34200000,10000,10000,10000,10000,5\n" * rows)


def test_only_folders_of_wanted_symbols_are_listed(spark, tmp_path):
    root = tmp_path / "in"
    for symbol in ("aa", "Bb", "c-1", "x.y"):
        for day in ("20240102", "20240103"):
            zipped(root / symbol, day)
    files = B._minute_archives(spark, str(root), ["BB", "C-1"], None, None)
    assert {p.split("/")[-2] for p in files.inputFiles()} == {"Bb", "c-1"} and files.count() == 4
    got = B.read_minute_zips(spark, str(root), ["bb", "X.y", "absent"], "2024-01-03", "2024-01-03")
    assert sorted(r["symbol"] for r in got.collect()) == ["BB", "X.Y"]
    assert B.read_minute_zips(spark, str(root), ["absent"]).count() == 0
    assert B.read_minute_zips(spark, str(tmp_path), ["aa"]).count() == 2  # folders further down are found too


def test_archives_of_all_groups_are_written(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).cast("string").alias("symbol"), F.when(F.col("id") % 50 != 0, F.col("id")).alias("a"), (F.col("id") * 2.5).alias("b"))
    round_trips._write_zips(rows, ["symbol"], str(tmp_path), lambda s: f"{s}/x.zip", lambda s: f"{s}.csv")
    found = []
    for s in range(7):
        with zipfile.ZipFile(tmp_path / str(s) / "x.zip") as z:
            assert z.namelist() == [f"{s}.csv"]
            found += [(s, line) for line in z.read(f"{s}.csv").decode().splitlines()]
    assert sorted(found) == sorted((k % 7, f"{k if k % 50 else ''},{k * 2.5}") for k in range(300))


def test_histories_of_many_symbols_share_few_states(spark, tmp_path, monkeypatch):
    """Four states for sixty symbols, with the rows that a state for each symbol gives."""
    monkeypatch.setattr(stream, "HISTORY_BUCKETS", 4)
    rng = np.random.default_rng(4)
    schema = "symbol long, date date, open double, high double, low double, close double, volume double, vwap double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    held, want, mark = {}, [], None
    begin = dt.date(2024, 1, 1)
    for part in range(3):
        days = {(int(s), begin + dt.timedelta(int(d))) for s, d in zip(rng.integers(0, 60, 90), rng.integers(25 * part, 25 * part + 30, 90), strict=True)}
        rows = [(s, d, *[float(s + d.toordinal() + part)] * 6) for s, d in sorted(days)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query = (
            stream.bounded_history(spark.readStream.schema(schema).parquet(source), 3, 2, 20, "5 days").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        fresh = [r for r in rows if mark is None or r[1] > mark]
        for s in {r[0] for r in fresh}:
            bars = {**held.get(s, {}), **{r[1]: r[2] for r in fresh if r[0] == s}}
            held[s] = dict(sorted(bars.items())[-3:])
            want.append((s, len(held[s]), str(max(held[s])), len(held[s]) >= 2, list(held[s].values())))
        mark = max([r[1] for r in fresh] + ([mark + dt.timedelta(5)] if mark else [])) - dt.timedelta(5)
        for s in [s for s, bars in held.items() if mark > max(bars) + dt.timedelta(20)]:
            want.append((s, 0, str(max(held.pop(s))), False, []))
    got = [(r["symbol"], r["bars"], r["last_date"], r["enough"], [h["close"] for h in r["history"]]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and any(w[1] == 0 for w in want)
