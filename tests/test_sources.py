"""Readers and writers on small files made here."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factorspark.operators import panel as P
from factorspark.operators import portfolio as G
from factorspark.sources import bars as B
from factorspark.sources import store as S


def minute_zip(root, symbol, day, rows):
    folder = root / symbol.lower()
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / f"{day}_trade.zip", "w") as z:
        z.writestr(f"{day}_{symbol.lower()}_minute_trade.csv", "\n".join(",".join(map(str, r)) for r in rows))


OPEN = 9 * 3600 * 1000 + 30 * 60 * 1000
ROWS = [(OPEN, 1000000, 1010000, 990000, 1005000, 100), (OPEN + 60_000, 1005000, 1020000, 1000000, 1015000, 300), (OPEN + 4 * 3_600_000, 1015000, 1030000, 1010000, 1020000, 50)]


def test_minute_zips(spark, tmp_path):
    for symbol in ("AAA", "BBB"):
        for day in ("20240102", "20240103"):
            minute_zip(tmp_path, symbol, day, ROWS)
    (tmp_path / "aaa" / "20240104_trade.zip").write_bytes(b"broken")
    df = B.read_minute_zips(spark, str(tmp_path), ["AAA"], "2024-01-03", "2024-01-31")
    rows = df.orderBy("datetime").collect()
    assert [r["symbol"] for r in rows] == ["AAA"] * 3
    assert rows[0]["datetime"] == dt.datetime(2024, 1, 3, 9, 30)
    assert (rows[0]["open"], rows[0]["low"], rows[0]["volume"]) == (100.0, 99.0, 100.0)
    assert B.read_minute_zips(spark, str(tmp_path)).count() == 12

    bars = {r["session"]: r for r in P.session_bars(df).collect()}
    assert (bars["AM"]["open"], bars["AM"]["high"], bars["AM"]["close"], bars["AM"]["volume"]) == (100.0, 102.0, 101.5, 400.0)
    assert bars["AM"]["vwap"] == pytest.approx((100.5 * 100 + 101.5 * 300) / 400)
    assert bars["PM"]["close"] == 102.0


def test_minute_zips_read_only_what_is_wanted(spark, tmp_path):
    for symbol in ("AAA", "BBB"):
        for day in range(10):
            minute_zip(tmp_path, symbol, f"202401{day + 10}", ROWS)
    df = B.read_minute_zips(spark, str(tmp_path), ["BBB"], "2024-01-12", "2024-01-14")
    assert df.count() == 9
    rows = df.select("symbol", "close")
    rows.collect()
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    assert [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())] == [3]


def test_minute_zips_take_the_named_member_and_tell_broken_ones(spark, tmp_path):
    minute_zip(tmp_path, "AAA", "20240102", ROWS)
    path = tmp_path / "aaa" / "20240103_trade.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.csv", "1,1,1,1,1,1")
        z.writestr("20240103_aaa_minute_trade.csv", ",".join(map(str, ROWS[1])))
    (tmp_path / "aaa" / "20240104_trade.zip").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "aaa" / "20240105_trade.zip", "w") as z:
        z.writestr("a.csv", "1,1,1,1,1,1")
        z.writestr("b.csv", "1,1,1,1,1,1")
    got = B.read_minute_zips(spark, str(tmp_path))
    assert got.count() == 4 and got.filter("datetime >= '2024-01-03'").first()["close"] == 101.5
    faults = {r["path"][-18:]: r["fault"] for r in B.broken_minute_zips(spark, str(tmp_path)).collect()}
    assert set(faults) == {"20240104_trade.zip", "20240105_trade.zip"} and "no member" in faults["20240105_trade.zip"]
    with pytest.raises(Exception, match="20240104_trade.zip"):
        B.read_minute_zips(spark, str(tmp_path), broken="raise").count()


def test_minute_csv(spark, tmp_path):
    (tmp_path / "aaa").mkdir()
    (tmp_path / "aaa" / "20240102_aaa_minute_trade.csv").write_text("\n".join(",".join(map(str, r)) for r in ROWS))
    rows = B.read_minute_csv(spark, str(tmp_path)).orderBy("datetime").collect()
    assert len(rows) == 3 and rows[1]["symbol"] == "AAA" and rows[1]["close"] == 101.5


def test_daily_zips(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "brk.b.zip", "w") as z:
        z.writestr("brkb.csv", "20230103 00:00,505600,509600,495500,503700,14357184\n20230104,1,1,1,1,5")
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("something.csv", "20230103 00:00,10000,20000,5000,15000,7")
    df = B.read_daily_zips(spark, str(tmp_path), start="2023-01-03", end="2023-01-03").orderBy("symbol")
    rows = df.collect()
    assert [(r["symbol"], r["date"], r["close"]) for r in rows] == [("BRK.B", dt.date(2023, 1, 3), 50.37), ("ODD", dt.date(2023, 1, 3), 1.5)]
    unscaled = B.read_daily_zips(spark, str(tmp_path), ["odd"], scale=1.0).first()
    assert unscaled["close"] == 15000.0


def test_fundamentals_and_shares(spark, tmp_path):
    spark.createDataFrame([("abc", "2024-01-02", 1.0)], "symbol string, date string, pe_ratio double").write.parquet(str(tmp_path / "f"))
    row = B.read_fundamentals(spark, str(tmp_path / "f")).first()
    assert (row["symbol"], row["date"]) == ("ABC", dt.date(2024, 1, 2))
    (tmp_path / "s.csv").write_text("symbol,shares_outstanding\nABC,100\nABC,100\nDEF,5\n")
    assert B.read_shares(spark, str(tmp_path / "s.csv")).count() == 2


def test_store_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(s, dt.date(2024, 1, d), x, 1.0 * d, 2.0) for s in ("A", "B") for d in range(2, 6) for x in ("AM", "PM")]
    df = spark.createDataFrame(rows, "symbol string, date date, session string, return double, TE_x_126 double")
    S.write_store(df, path)
    S.write_store(df.filter("date = '2024-01-05'").withColumn("return", F.lit(99.0)), path)  # replaces that date only
    got = S.read_store(spark, path, "2024-01-03", "2024-01-05", ["return*"], ["A"], ["AM"])
    assert set(got.columns) == {"symbol", "date", "session", "return"}
    assert sorted(r["return"] for r in got.collect()) == [3.0, 4.0, 99.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "TE_x_126" not in plan and "PushedFilters: [In(symbol" in plan.replace("IsNotNull(symbol), ", "") or "EqualTo(symbol,A)" in plan


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("A", 2, 1.0), ("A", 1, 2.0), ("B", 1, 3.0)], "symbol string, date int, x double")
    S.export(df, str(tmp_path), ["parquet", "csv", "per_symbol_csv"])
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    a = spark.read.option("header", True).csv(str(tmp_path / "per_symbol" / "_symbol=A")).collect()
    assert [r["date"] for r in a] == ["1", "2"]


def test_pools_and_factor_sets(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps({"exprs": ["$close", "Abs($open)"], "weights": [0.5, -0.25]}, indent=2))
    rows = S.read_pools(spark, str(tmp_path / "p")).orderBy("idx").collect()
    assert [(r["pool"], r["idx"], r["expr"], r["weight"]) for r in rows] == [("one", 0, "$close", 0.5), ("one", 1, "Abs($open)", -0.25)]
    S.write_pools(S.read_pools(spark, str(tmp_path / "p")).withColumnRenamed("pool", "pool_id"), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["exprs"] == ["$close", "Abs($open)"] and back["weights"] == [0.5, -0.25]

    w = spark.createDataFrame(
        [("2024_01", ["2024-01-01", "2024-02-01"], 0, 0.1, None, ["$close"], [1.0]), ("2024_03", ["2024-03-01", "2024-04-01"], 2, 0.2, 0.1, ["$open", "$low"], [1.0])],
        "deploy_month string, deploy_range array<string>, window_idx int, train_ic double, deploy_ic double, expressions array<string>, weights array<double>",
    )
    S.write_factor_sets(w, str(tmp_path / "sets"))
    manifest = spark.read.json(str(tmp_path / "sets" / "manifest")).first()
    assert manifest["n_windows"] == 2 and manifest["files"] == ["2024_01.json", "2024_03.json"]
    months = spark.sql("SELECT explode(sequence(DATE'2023-12-01', DATE'2024-04-01', INTERVAL 1 MONTH)) AS month")
    asof = {str(r["month"]): r["exprs"] for r in G.factor_sets_as_of(months, S.read_factor_sets(spark, str(tmp_path / "sets"))).collect()}
    # The set of March is broken (two formulas, one weight): January's stays in use.
    assert asof["2023-12-01"] is None and asof["2024-02-01"] == ["$close"] and asof["2024-04-01"] == ["$close"]


def test_ranked_and_metric_log(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i}") for i in range(1, 31)], "rank int, symbol string")
    S.write_ranked(df, str(tmp_path / "r"), 10, 10)
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "top")).agg(F.max(F.col("rank").cast("int"))).first()[0] == 10
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "bottom")).agg(F.min(F.col("rank").cast("int"))).first()[0] == 21
    for i in range(2):
        S.append_metrics(spark.createDataFrame([(i, 0.1)], "step int, ic double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_unknown_session_and_feature(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), "NOON")], "symbol string, date date, session string")
    with pytest.raises(Exception, match="unknown session"):
        P.session_timestamp(df, {"AM": 0}).collect()
    with pytest.raises(ValueError):
        P.feature_name("FeatureType.Nope")
    with pytest.raises(ValueError):
        P.common_symbols(df, df.withColumn("symbol", F.lit("B")))
