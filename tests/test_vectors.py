"""Hand vectors and brute force for what has no SQL."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.catalog.fixtures import FORWARD, POOL, panel
from factorspark.operators import fitness as N
from factorspark.operators import metrics as M
from factorspark.operators import pool as K
from factorspark.operators import portfolio as G
from factorspark.operators import style as Y
from factorspark.operators import symbolic as Z
from factorspark.operators import windows as T
from factorspark.operators.panel import densify
from factorspark.plans.evaluate import add_factors, factor_table

SMALL = "/root/testdata/sf0.001"


def series(spark, values, symbol="A"):
    rows = [(symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return densify(spark.createDataFrame(rows, "symbol string, date date, close double"))


def last(spark, values, formula):
    return factor_table(series(spark, values), {"v": formula}).orderBy("date").collect()[-1]["v"]


def test_hand_vectors(spark):
    assert last(spark, [1, 2, 3, 4.5], "Med($close,4d)") == 2.0
    assert last(spark, [1.0, 2, 3], "WMA($close,3d)") == pytest.approx((2 + 2 * 3) / 3)
    assert last(spark, [1.0, 2, 3, 10], "Rank($close,4d)") == 0.25
    assert last(spark, [5.0, 5, 5, 5], "Rank($close,4d)") == pytest.approx((0 + 4 + 1) / 8)
    assert last(spark, [1.0, 2, None], "Rank($close,3d)") == 0.0
    assert last(spark, [1.0, None, 3], "Mean($close,3d)") is None
    assert last(spark, [1.0, None, 3], "Ref($close,2d)") == 1.0
    assert last(spark, [1.0, 3, 2, 4], "RSI($close,4d)") == pytest.approx(100 - 100 / (1 + (4 / 3) / (1 / 3 + 1e-8)))
    assert last(spark, [2.0, 4, 4], "Corr($close,$close,3d)") == pytest.approx(1.0)
    assert last(spark, [3.0, 3, 3], "Corr($close,$close,3d)") == 0.0
    assert last(spark, [1.0, 2], "Div($close,Sub($close,$close))") is None


def test_moment_identities(spark):
    x = np.random.default_rng(3).normal(size=20)
    out = factor_table(series(spark, map(float, x)), {n: f"{n}($close,20d)" for n in ("Skew", "Kurt", "EMA", "DEMA", "TEMA", "Mad")})
    row = out.orderBy("date").collect()[-1]
    d = x - x.mean()
    assert row["Kurt"] == pytest.approx((d**4).mean() / x.var(ddof=1) ** 2 - 3)
    assert row["Skew"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert row["Mad"] == pytest.approx(np.abs(d).mean())
    w = (1 - 2 / 21) ** np.arange(20, 0, -1)
    assert row["EMA"] == pytest.approx((w * x).sum() / w.sum())
    assert row["EMA"] == row["DEMA"] == row["TEMA"]


def test_recursive_ema_with_gaps(spark):
    from factorspark.plans.formula import FormulaOptions

    x = [1.0, None, 3.0, 4.0, None, 2.0]
    p, scoring = series(spark, x), FormulaOptions(dialect="scoring")
    traded = p.over(p.df.withColumn("volume", F.lit(1.0)))  # the rows exist, only their close is missing
    got = factor_table(traded, {"v": "EMA($close,3d)"}, scoring).orderBy("date").toPandas()["v"]
    want = pd.Series(x, dtype=float).ewm(span=3, adjust=False, min_periods=1).mean()
    np.testing.assert_allclose(got.astype(float), want)
    # Without any value the days do not exist for the symbol.
    got = factor_table(p, {"v": "EMA($close,3d)"}, scoring).orderBy("date").toPandas()["v"].astype(float)
    own = pd.Series(x, dtype=float).dropna().ewm(span=3, adjust=False, min_periods=1).mean()
    assert got.isna().tolist() == [v is None for v in x]
    np.testing.assert_allclose(got.dropna(), own)


def test_normalised_ic_equals_explicit_zscores(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", dt.date(2024, 1, 1 + t), None if rng.random() < 0.2 else float(rng.normal() + 1e3), None if rng.random() < 0.2 else float(rng.normal())) for t in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double")
    got = {r["date"]: r["ic"] for r in M.normalised_ic(df, F.col("x"), F.col("y"), ["date"]).collect()}
    p = pd.DataFrame(rows, columns=["symbol", "date", "x", "y"])
    for d, g in p.groupby("date"):
        z = [((g[c] - g[c].mean()) / g[c].std(ddof=0)).fillna(0.0) for c in ("x", "y")]
        assert got[d] == pytest.approx(np.corrcoef(*z)[0, 1])


def test_ic_properties(spark):
    p = add_factors(panel(spark, SMALL), {"a": "$close", "b": "Log($close)"})
    same = M.daily_ic(p.df, "a", "a").agg(F.min("ic"), F.max("ic")).first()
    assert same[0] == pytest.approx(1.0) and same[1] == pytest.approx(1.0)
    mono = M.daily_rank_ic(p.over(p.df.select("symbol", "date", "a", "b")), "a", "b").agg(F.min("rank_ic")).first()[0]
    assert mono == pytest.approx(1.0)


def numpy_statistics(spark):
    names = {f"a{i}": f for i, f in enumerate(POOL)}
    p = add_factors(panel(spark, SMALL), {**names, "y": FORWARD}).df.select("date", *names, "y").toPandas()
    cols = [*names, "y"]
    daily = []
    for _, g in p.groupby("date"):
        z = ((g[cols] - g[cols].mean()) / g[cols].std(ddof=0)).replace([np.inf, -np.inf], np.nan).fillna(0.0).to_numpy(float)
        c = z.T @ z / len(z) - np.outer(z.mean(0), z.mean(0))
        s = z.std(0)
        scale = np.outer(s, s)
        low = s < 1e-3
        scale[low | low[:, None]] = 1.0
        daily.append(c / scale)
    mean = np.mean(daily, axis=0)
    return mean[:-1, -1], mean[:-1, :-1], np.array(daily)


def test_pool_statistics_and_weights(spark):
    ics, mutual, _ = numpy_statistics(spark)
    np.fill_diagonal(mutual, 1.0)
    stats = K.pool_statistics(panel(spark, SMALL), list(POOL), FORWARD)
    np.testing.assert_allclose(stats.ics, ics, atol=1e-9)
    np.testing.assert_allclose(stats.mutual, mutual, atol=1e-9)
    exact = K.fit_weights(stats.mutual, stats.ics, 0.0)
    np.testing.assert_allclose(stats.mutual @ exact, stats.ics, atol=1e-9)
    l1 = K.fit_weights(stats.mutual, stats.ics, 0.05)
    best = K.mse_loss(l1, stats.mutual, stats.ics, 0.05)
    rng = np.random.default_rng(0)
    for _ in range(500):
        assert best <= K.mse_loss(l1 + rng.normal(scale=0.05, size=len(l1)), stats.mutual, stats.ics, 0.05) + 1e-12


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_daily_objectives_improve(spark, monkeypatch, local):
    """Read once or by a job per step: the same sums."""
    monkeypatch.setattr(K, "LOCAL_NUMBERS", local)
    stats = K.pool_statistics(panel(spark, SMALL), list(POOL), FORWARD, keep_daily=True)
    assert (stats.daily.local is None) == (local == 0)
    for beta in (None, 0.5):
        start, slope = stats.daily.objective(stats.ics, beta)
        fitted = K.fit_weights_daily(stats, alpha=0.0, lcb_beta=beta, steps=50 if local else 3)
        assert stats.daily.objective(fitted, beta)[0] >= start
        step = 1e-6 * np.eye(len(slope))
        ahead = [stats.daily.objective(stats.ics + e, beta)[0] - stats.daily.objective(stats.ics - e, beta)[0] for e in step]
        assert np.allclose(slope, np.array(ahead) / 2e-6, rtol=1e-4, atol=1e-6)
    w = np.array(list(POOL.values()))
    daily = M.pool_daily(panel(spark, SMALL), POOL, FORWARD).agg(F.avg("ic") / F.stddev_samp("ic")).first()[0]
    assert stats.daily.objective(w)[0] == pytest.approx(daily)
    assert K.cross_validated_weights(stats, 4).shape == (len(POOL),)


def test_pool_admission_when_empty_or_weak(spark):
    p = panel(spark, SMALL)
    names = list(POOL)
    ics = {e: float(i) for e, i in zip(K.force_load(p, names, FORWARD).exprs, K.force_load(p, names, FORWARD).ics, strict=True)}
    bound = max(abs(v) for v in ics.values()) + 1.0
    pool = K.extend_pool(p, K.Pool(3), names, FORWARD, lower_bound=bound)
    assert pool.exprs == [list(ics)[-1]] and sum(e["removed"] is not None for e in pool.log) == len(names) - 1
    loaded = K.force_load(p, names, FORWARD, capacity=3)
    assert loaded.exprs == list(ics)[:3]
    assert np.allclose(loaded.weights, K.fit_weights(loaded.mutual, loaded.ics, 5e-3))


def test_pool_growth_eviction_and_edit(spark):
    p = panel(spark, SMALL)
    full = K.extend_pool(p, K.Pool(10), list(POOL), FORWARD, alpha=0.0)
    assert set(full.exprs) == set(POOL) and all(e["failure"] is None for e in full.log)
    small = K.extend_pool(p, K.Pool(2), list(POOL), FORWARD, alpha=0.0)
    assert len(small.exprs) == 2 and sum(e["removed"] is not None for e in small.log) == 3
    strict = K.extend_pool(p, K.Pool(10, full.exprs, full.weights, full.ics, full.mutual), ["Mul($high,$low)"], FORWARD, lower_bound=10.0)
    assert strict.exprs == full.exprs and {e["failure"] for e in strict.log} == {"ic below bound"}
    twice = K.extend_pool(p, full, ["Mul(2.0,Sub($high,$low))"], FORWARD, alpha=0.0)
    assert twice.log[-1]["failure"] == "mutual ic above limit"
    edited, change = K.bulk_edit(p, full, [0], ["Mean($close,4d)"], FORWARD)
    assert change["removed"] == [full.exprs[0]] and change["added"] == ["Mean($close,4d)"]
    assert K.most_significant(full, 2) == list(np.argsort(-np.abs(full.weights))[:2])
    assert K.leave_only(full, 3).weights.shape == (3,)
    loaded = K.force_load(p, [*POOL, *POOL], FORWARD, weights=[*POOL.values(), *POOL.values()])
    assert loaded.as_dict() == POOL


def test_greedy_and_hall_of_fame():
    c = np.array([[1, 0.9, 0.1, 0.2], [0.9, 1, 0.3, 0.1], [0.1, 0.3, 1, -0.8], [0.2, 0.1, -0.8, 1]])
    assert K.greedy_decorrelated([0, 1, 2, 3], c, 0.7) == [0, 2]
    assert K.greedy_decorrelated([1, 3, 0, 2], c, 0.7, 1) == [1]
    assert K.decorrelated_hall_of_fame(c, 3) == [0, 2, 3]
    assert K.decorrelated_hall_of_fame(c, 2) == [0, 2]


def test_swap_decision_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(12):
        for i in range(25):
            held = rng.random() < 0.3
            rows.append((d, f"s{i:02d}", bool(rng.random() < 0.8), bool(rng.random() < 0.8), None if rng.random() < 0.1 else float(rng.normal()), int(rng.integers(0, 4)) if held else None))
    schema = "date int, symbol string, buyable boolean, sellable boolean, signal double, days_holded int"
    got = {tuple(r) for r in G.swap_decision(spark.createDataFrame(rows, schema), 10, 2, 2).select("date", "symbol", "action").collect()}
    want = set()
    for d in range(12):
        day = [r for r in rows if r[0] == d and r[4] is not None]
        queue = sorted((r for r in day if r[5] is not None and r[3] and r[5] >= 2), key=lambda r: (-r[4], r[1]))
        room = 10 - sum(r[5] is not None for r in rows if r[0] == d)
        swaps = opens = 0
        for r in sorted((r for r in day if r[5] is None and r[2]), key=lambda r: (-r[4], r[1])):
            if swaps < 2 and queue and r[4] > queue[-1][4]:
                want |= {(d, r[1], "swap_in"), (d, queue.pop()[1], "swap_out")}
                swaps += 1
            elif opens < room:
                want.add((d, r[1], "open"))
                opens += 1
            else:
                break
    assert got == want


def test_rolling_windows_example(spark):
    w = T.rolling_windows(spark, "2023-01-01", "2024-01-01", "2024-06-30", 12, 1, 1).orderBy("window_idx").collect()
    assert len(w) == 6 and w[0]["train_start"] == dt.date(2023, 1, 1) and w[0]["train_end"] == dt.date(2023, 12, 31)
    assert w[-1]["deploy_end"] == dt.date(2024, 6, 30) and w[-1]["deploy_month"] == "2024_06"
    df = T.rolling_windows(spark, "2023-01-01", "2024-01-01", "2024-06-30")
    assert T.window_of_month(df, "2024-03").first()["window_idx"] == T.window_of_index(df, 2).first()["window_idx"] == 2


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_rolling_residuals_brute_force(spark, k):
    """Fits of windows with missing values, a regressor that repeats another one, and a shifted level."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, k)) + 3, rng.normal(size=60) - 2
    x[5, k - 1] = y[17] = np.nan
    if k > 2:
        x[30:50, 2] = x[30:50, 0] - x[30:50, 1]
    frame = [(0, i, None if np.isnan(y[i]) else float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(60)]
    names = [f"x{j}" for j in range(k)]
    df = spark.createDataFrame(frame, "symbol int, date int, y double, " + ", ".join(f"{c} double" for c in names))
    out = Y.with_rolling_residual(df, "y", names, 12, Y.DAY, "e")
    assert out.columns == ["symbol", "date", "y", *names, "e"]
    got = [r["e"] for r in out.orderBy("date").collect()]
    for end in range(1, 61):
        rows = [i for i in range(max(0, end - 12), end) if not np.isnan(y[i]) and not np.isnan(x[i]).any()]
        if end < 12 or len(rows) < max(5, k + 1) or end - 1 not in rows:
            assert got[end - 1] is None
            continue
        a = np.column_stack([np.ones(len(rows)), x[rows]])
        beta = np.linalg.lstsq(a, y[rows], rcond=None)[0]
        assert got[end - 1] == pytest.approx(y[end - 1] - beta[0] - x[end - 1] @ beta[1:], abs=1e-9)


def test_weighted_metrics_against_numpy(spark):
    rng = np.random.default_rng(7)
    y, p, w = rng.normal(size=300) + 1e6, rng.normal(size=300) + 1e6, rng.uniform(0.1, 2, 300)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, p, w))], "id int, y double, p double, w double")
    got = N.weighted_metrics(df, ["pearson", "spearman", "mse"], w="w", unique=["id"]).first().asDict()

    def pearson(a, b):
        a, b = a - np.average(a, weights=w), b - np.average(b, weights=w)
        return abs((w * a * b).sum() / np.sqrt((w * a * a).sum() * (w * b * b).sum()))

    assert got["pearson"] == pytest.approx(pearson(y, p), rel=1e-6)
    assert got["spearman"] == pytest.approx(pearson(pd.Series(y).rank(), pd.Series(p).rank()), rel=1e-9)
    assert got["mse"] == pytest.approx(np.average((p - y) ** 2, weights=w))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")
    assert N.weighted_metrics(flat, ["pearson"]).first()[0] == 0.0


def test_registered_metric(spark):
    N.register_metric("bias", lambda y, p, w: F.sum(w * (p - y)) / F.sum(w), False)
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "y double, p double")
    assert N.weighted_metrics(df, ["bias"]).first()["bias"] == 2.0


def test_polynomial_models(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(-2, 2, size=(400, 2))
    y = 1.5 - 2 * x[:, 0] + 0.7 * x[:, 0] * x[:, 1] + rng.normal(scale=0.05, size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])], "a double, b double, y double")
    full = Z.fit_polynomial(df, ["a", "b"], "y", 2)
    design = np.column_stack([np.prod(x**np.array(e), axis=1) for e in full.exponents])
    np.testing.assert_allclose(full.coefficients, np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-8)
    few = Z.fit_polynomial(df, ["a", "b"], "y", 2, cutoff_p_value=1e-6)
    kept = {e for e, c in zip(few.exponents, few.coefficients) if c}
    assert kept == {(0, 0), (1, 0), (1, 1)}
    lasso = Z.fit_lasso(df, ["a", "b"], "y", 2, gamma=0.3, refit=False)

    def loss(b):
        return ((y - design @ b) ** 2).sum() / (2 * len(y) * y.var()) + 0.3 / len(b) * np.abs(b).sum()

    for _ in range(300):
        assert loss(lasso.coefficients) <= loss(lasso.coefficients + rng.normal(scale=0.05, size=6)) + 1e-12
    assert Z.t_test_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_class_weights_need_two_classes(spark):
    with pytest.raises(ValueError):
        Z.class_weights(spark.createDataFrame([(1,), (1,)], "c int"), "c").count()


def test_no_column_is_read_that_is_not_needed(spark):
    from factorspark.catalog import QUERIES

    plan = QUERIES["ts_mean"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan.split("Relation")[0]
    physical = QUERIES["ts_mean"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in physical.splitlines() if "FileScan" in line][0]
    assert "l_returnflag" not in scan and "l_orderkey" not in scan


def test_formulas_share_shuffles(spark):
    """Twenty rolling formulas cost no more shuffles than one."""
    p = panel(spark, SMALL)

    def shuffles(n):
        df = factor_table(p, {f"f{i}": f"Mean($close,{i + 2}d)" for i in range(n)})
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(20) == shuffles(1)
