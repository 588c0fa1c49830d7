"""FEAST against a plain eigen-decomposition, and whitening against brute force in whole numbers."""

import math

import numpy as np
import pytest

from factorspark.llm import feast, whitening

SMALL = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)
TURN = np.linalg.qr(RNG.normal(size=(24, 24)))[0]


def rotated(values):
    return (TURN * np.asarray(values, dtype=float)) @ TURN.T


@pytest.mark.parametrize(
    "values",
    [
        RNG.uniform(0.1, 9, 24), [5.0] * 14 + [1.0] * 10, [1.0] * 24, [7.0] * 3 + [0.0] * 21, 10.0 ** -np.arange(24),
        [100, 50, *np.linspace(1, 1.0001, 22)], [0.0] * 24,
    ],
)
@pytest.mark.parametrize("k", [1, 10, 32])
def test_feast(values, k):
    a = rotated(values)
    parts = feast.intervals(a, k)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    want = want[want > 24 * 8 * feast.EPS * np.abs(a).sum(axis=1).max()][:k]
    if not len(want):
        assert parts == []
        return
    got, vectors = feast.combine(a, [feast.eigenpairs(a, *p)[1] for p in parts], k)
    norm = np.abs(a).max()
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-13 * norm
    assert np.abs(a @ vectors - vectors * got).max() < 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13


def test_inertia():
    a = rotated(np.arange(24) - 11.5)
    t = feast.tridiagonal(a)
    for shift in (-20, -11.6, -3, 0, 4.2, 30):
        assert feast.below(t, shift)[0] == (np.arange(24) - 11.5 < shift).sum()


def test_missed_pairs_are_noticed():
    with pytest.raises(ArithmeticError):
        feast.eigenpairs(rotated(np.arange(24) + 1), 0.5, 2.5, 3)


def brute(vectors, components=32):
    """(n, squared deviations, whitened, explained) by whole numbers and a plain eigen-decomposition."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return n, deviation, centred @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, white, explained = brute([v for _, v in rows])
    at = {key: i for i, (key, _) in enumerate(rows)}
    got = whitening.whitened_rows(df).collect()
    assert len(got) == n * 32
    table = np.zeros((n, 32))
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        table[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < 1e-8


NAN, INF = float("nan"), float("inf")
EDGES = [(1, [1.0, 2.0, 0.5], "a"), (1, [1.0, 2.0, 0.5], "a"), (None, [0.0, -3.0, 4.0], None), (4, None, "x"), (5, [1.0, None, 2.0], "x"), (6, [NAN, 1.0, 1.0], "x"), (7, [INF, 0.0, 0.0], "x"), (8, [9.5, 0.0, 0.25], "x"), (9, [], "x"), (10, [0.1, 0.2, 7.0], "y")]
SCHEMA = "vec_id long, embedding array<float>, whitened string"


def test_edges(spark):
    got = whitening.whitened_rows(spark.createDataFrame(EDGES, SCHEMA)).collect()
    kept = [v for k, v, _ in EDGES if k in (1, None, 8, 10)]
    n, deviation, white, _ = brute([np.float32(v) for v in kept])
    assert len(got) == 3 * n == 15 and {r["component"] for r in got} == {1, 2, 3}
    assert sorted({r["deviation"] for r in got}) == sorted(set(deviation))
    assert sum(r["vec_id"] == 1 for r in got) == 6 and sum(r["vec_id"] is None for r in got) == 3
    assert np.allclose(sorted(abs(r["whitened"]) for r in got), sorted(np.abs(white).ravel()))


def test_nothing_to_whiten(spark):
    for rows in ([], EDGES[3:7], EDGES[:2]):
        got = whitening.whitened_rows(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_lengths_and_spread(spark):
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0], "")], SCHEMA))
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [1e9, 2.0], ""), (2, [1.0, 3.0], "")], SCHEMA))


def test_wide_entries_stay_exact(spark):
    rows = [(k, [float(RNG.integers(-1 << 19, 1 << 19)) / 2 for _ in range(4)], "") for k in range(500)]
    n, deviation, _, explained = brute([v for _, v, _ in rows])
    model = whitening.fit(spark.createDataFrame(rows, SCHEMA))
    assert np.allclose(model.explained, explained, rtol=1e-12)
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA), model).select("vec_id", "white.deviation").collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in out} == dict(enumerate(deviation))
