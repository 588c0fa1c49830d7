"""The plans for groups and sides that outgrow one task give the same answers as the short ones."""

import pytest

from factorspark.operators import panel as P
from factorspark.operators import scale
from factorspark.plans import evaluate

SPLIT = [
    "cs_rank", "cs_average_rank", "cs_rank_columns", "cs_winsorize", "cs_median_fill", "cs_zscore", "expr_alternating",
    "ic_daily", "rank_ic_daily", "rank_ic_daily_raw", "pool_metrics", "turnover_samples", "walk_forward", "top_k",
    "long_only", "long_short", "swap_decision", "proxy_score", "score_summary", "weighted_spearman", "spearman",
    "weighted_quantile", "quantile_filter", "skyline", "calendar", "universe_range_join", "incremental_append",
    "te_share", "market_values", "align_calendar", "asof_fill", "readjust", "portfolio_diff", "risk_summary", "pareto_front",
    "factor_sets_as_of", "segment_metrics", "window_panel", "hall_decorrelated_ranks",
]


@pytest.fixture
def tiny_bounds(monkeypatch):
    monkeypatch.setattr(scale, "MAX_GROUP_ROWS", 3)
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 5)


@pytest.mark.parametrize("name", SPLIT)
def test_small_bounds(check, tiny_bounds, name):
    check(name)


@pytest.mark.parametrize("name", ["densify", "ts_mean", "ranged_panel"])
def test_long_calendar(check, tiny_bounds, monkeypatch, name):
    monkeypatch.setattr(P, "MAX_LOCAL_DATES", 4)
    check(name)


@pytest.mark.parametrize("name", ["densify", "align_calendar", "ts_mean", "ts_ref"])
@pytest.mark.parametrize("size", [1, 7])
def test_gaps_are_filled_by_blocks(check, monkeypatch, name, size):
    """A calendar longer than the bound is cut into blocks: the same rows."""
    monkeypatch.setattr(P, "BLOCK_DATES", size)
    check(name)


BLOCKED = ["ts_ref", "ts_ref_ahead", "ts_delta", "ts_med", "ts_rank", "ts_wma", "ts_rsi", "ts_corr", "ts_tema_true", "expr_nested", "expr_alternating", "expr_many", "pool_daily", "deploy_ema", "scoring_mean_sparse", "scoring_ema_sparse", "deploy_rank_sparse", "deploy_ref_sparse"]


@pytest.mark.parametrize("name", BLOCKED)
def test_blocked_series(check, monkeypatch, name):
    """Series cut into blocks of 7 rows with borrowed neighbours."""
    original = evaluate.add_factors

    def blocked(panel, formulas, options=evaluate.DEFAULT, block_rows=7):
        return original(panel, formulas, options, 7)

    from factorspark.catalog import factors, metrics
    from factorspark.operators import metrics as M

    for module in (evaluate, metrics, M):
        monkeypatch.setattr(module, "add_factors", blocked)
    assert factors.factor_table is evaluate.factor_table
    check(name)


def test_dense_width_counts_symbols_that_never_meet(spark):
    """Every symbol trades on a day of its own: a dense date still holds all of them, and the split routes know."""
    from pyspark.sql import functions as F

    bars = spark.range(40).select(F.col("id").alias("symbol"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
    dense = P.densify(bars)
    assert dense.n_dates == 40 and 36 <= dense.n_symbols <= 50 and dense.df.count() == 1600


def test_hot_group_is_ordered_over_many_tasks(spark, monkeypatch):
    """A third of the rows share one key and one value: positions are whole and the key spans several partitions."""
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("g"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.rand(1)).alias("x"),
    )
    out = scale.ordered_position(df, ["g"], [F.col("x"), F.col("id")], "at").cache()
    bad = out.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("d"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    assert bad.filter("n <> d OR lo <> 0 OR hi <> n - 1").count() == 0
    pdf = out.filter("g = 'hot'").toPandas().sort_values(["x", "id"])
    assert pdf["at"].tolist() == list(range(10_000))


def test_running_total_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.range(5_000).select("id", (F.col("id") % 7).cast("double").alias("w"))
    monkeypatch.setattr(scale, "MAX_GROUP_ROWS", 10)
    got = scale.running_total(df, [F.col("id")], "w", "cum").toPandas().sort_values("id")
    assert got["cum"].tolist() == got["w"].cumsum().tolist()


@pytest.mark.parametrize("rows", [1_000_000, 10])
@pytest.mark.parametrize("exclusive", [False, True])
def test_prefix_scan(spark, monkeypatch, rows, exclusive):
    """Sums, maxima and last present values, in one window and over parts, against a loop."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(scale, "MAX_GROUP_ROWS", rows)
    values = [None if k % 5 in (0, 3) or k < 40 else float((k * 7919) % 101 - 50) for k in range(600)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").repartition(8)
    what = {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}
    got = scale.prefix_scan(df, [F.col("k")], what, exclusive=exclusive).orderBy("k").select("s", "m", "l").collect()
    for k, row in enumerate(got):
        seen = [v for v in values[: k + (not exclusive)] if v is not None]
        assert tuple(row) == ((sum(seen), max(seen), seen[-1]) if seen else (None, None, None))


def test_many_spans_without_nested_loop(spark, monkeypatch):
    """300 000 segments, more than may be broadcast: joined by month, the same rows as one by one."""
    import datetime as dt

    from pyspark.sql import functions as F

    daily = spark.range(800).select(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("ic"))
    segments = spark.range(300_000).select(
        F.col("id").alias("segment"), F.date_add(F.lit("2019-12-01"), (F.col("id") % 850).cast("int")).alias("start_date"),
    ).withColumn("end_date", F.date_add("start_date", (F.col("segment") % 9 - 1).cast("int")))
    joined = scale.join_in_span(daily, segments, "date", "start_date", "end_date")
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    first, last = dt.date(2020, 1, 1), dt.date(2020, 1, 1) + dt.timedelta(799)
    want = 0
    for k in range(300_000):
        a = dt.date(2019, 12, 1) + dt.timedelta(k % 850)
        b = a + dt.timedelta(k % 9 - 1)
        want += max(0, (min(b, last) - max(a, first)).days + 1)
    assert joined.count() == want


@pytest.mark.parametrize("front", [20_000, 40])
def test_skyline_tree(spark, monkeypatch, front):
    """Merged in a tree or compared in chunks: the front of a brute-force search, with ties and opposed costs."""
    import numpy as np

    from factorspark.operators import fitness as N

    monkeypatch.setattr(N, "FRONT_ROWS", front)
    rng = np.random.default_rng(2)
    for opposed in (False, True):
        a = rng.integers(0, 60, size=(3000, 3)).astype(float)
        if opposed:
            a[:, 2] = 120 - a[:, 0] - a[:, 1] + rng.integers(0, 3, 3000)
        df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(a)], "id int, a double, b double, c double").repartition(16)
        points = {tuple(r): k for k, r in reversed(list(enumerate(a.tolist())))}
        p = np.array(list(points))
        good = [points[tuple(v)] for v in p.tolist() if not ((p <= v).all(axis=1) & (p < v).any(axis=1)).any()]
        assert sorted(r["id"] for r in N.skyline(df, ["a", "b", "c"], "id").collect()) == sorted(good)
