"""Products of formulas in blocks: many columns, candidates against members, batches of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.catalog.fixtures import FORWARD, POOL, panel
from factorspark.catalog.metrics import CANDIDATES
from factorspark.operators import metrics as M
from factorspark.operators import pool as K
from factorspark.operators.cross_section import zscore
from factorspark.operators.panel import Panel

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark):
    """60 symbols x 5 dates x 200 columns of random numbers, some equal, one constant."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=(300, 200))
    values[:, 7], values[:, 9] = values[:, 3], 1.0
    rows = [(k % 60, k // 60, v.tolist()) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol int, day int, v array<double>")
    cols = [f"c{i}" for i in range(200)]
    df = df.select("symbol", F.date_add(F.lit("2024-01-01"), F.col("day")).alias("date"), F.col("day").alias("date_idx"), *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    return Panel(df, 5, 60), cols, values.reshape(5, 60, 200)


def expected(values):
    out = []
    for day in values:
        s = day.std(axis=0)
        z = np.where(s > 1e-12, (day - day.mean(axis=0)) / np.where(s > 1e-12, s, 1), 0)
        out.append(z.T @ z / len(z))
    return np.array(out)


def test_many_columns(many):
    p, cols, values = many
    want = expected(values).mean(axis=0)
    got = M.mutual_ic_matrix(p, cols)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "map_from_entries" not in plan
    table = np.zeros((200, 200))
    for r in got.collect():
        table[r["i"], r["j"]] = r["ic"]
    np.fill_diagonal(want, 1.0)
    np.testing.assert_allclose(table, want, atol=1e-9)


def test_split_dates(many):
    """A date shared by several tasks: the same sums."""
    p, cols, values = many
    z = zscore(p, cols[:20])
    got = M.product_blocks(z, cols[:20], M.Pairs(20), salts=7).groupBy("date").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).collect()
    assert all(r["n"] == 60 and r["parts"] > 1 for r in got)


def test_rectangle(many):
    p, cols, values = many
    z = zscore(p, cols)
    want = expected(values).mean(axis=0)
    rows = M.mean_correlation_rows(z, [*cols[:3], *cols[3:50]], M.Pairs(3, 47)).collect()
    assert sorted(r["i"] for r in rows) == [0, 1, 2]
    for r in rows:
        np.testing.assert_allclose(r["ics"], want[r["i"], 3:50], atol=1e-9)


def same(a, b):
    assert a.exprs == b.exprs and [e["failure"] for e in a.log] == [e["failure"] for e in b.log] and [e["removed"] for e in a.log] == [e["removed"] for e in b.log]
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-12)
    np.testing.assert_allclose(a.mutual, b.mutual, atol=1e-12)


@pytest.mark.parametrize("limit", [0.99, 0.6])
def test_batches_do_not_matter(spark, monkeypatch, limit):
    p = panel(spark, SMALL)
    formulas = [*CANDIDATES, *POOL]
    at_once = K.extend_pool(p, K.Pool(3), formulas, FORWARD, alpha=1e-3, limit=limit)
    monkeypatch.setattr(K, "LEAST_BATCH", 1)
    same(K.extend_pool(p, K.Pool(3), formulas, FORWARD, alpha=1e-3, limit=limit), at_once)
    assert K.force_load(p, formulas, FORWARD, capacity=5).exprs == [str(K.parse(f, K.DEFAULT)) for f in formulas[:5]]


def test_selection_in_batches(spark, monkeypatch):
    p = panel(spark, SMALL)
    whole = K.select_decorrelated(p, list(CANDIDATES), FORWARD, 0.7, 4).collect()
    monkeypatch.setattr(K, "LEAST_BATCH", 1)
    assert [r["expr"] for r in K.select_decorrelated(p, list(CANDIDATES), FORWARD, 0.7, 4).collect()] == [r["expr"] for r in whole]
    exprs = [str(K.parse(f, K.DEFAULT)) for f in CANDIDATES]
    stats = K.pool_statistics(p, exprs, FORWARD)
    order = sorted(range(len(exprs)), key=lambda i: (-stats.ics[i], exprs[i]))
    assert [exprs[i] for i in K.greedy_decorrelated(order, stats.mutual, 0.7, 4)] == [r["expr"] for r in whole]


def test_numbers_read_grow_with_candidates_and_members(spark, monkeypatch):
    """No batch multiplies candidates with candidates of other batches."""
    read = []
    original = K._rows_to_matrix
    monkeypatch.setattr(K, "_rows_to_matrix", lambda rows, left, right: read.append(left * right) or original(rows, left, right))
    monkeypatch.setattr(K, "LEAST_BATCH", 2)
    formulas = [*CANDIDATES, *POOL]
    K.extend_pool(panel(spark, SMALL), K.Pool(2), formulas, FORWARD)
    assert sum(read) <= len(formulas) * (2 * 2 + 1)
