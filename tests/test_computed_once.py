"""Costly inputs are computed once, however often their rows are read."""

import numpy as np
import pandas as pd
import pytest

from factorspark.operators import portfolio as G
from factorspark.operators import scale
from factorspark.operators import symbolic as Z
from factorspark.sources import store as S


def counted(spark, rows=400):
    """A table whose Python source counts the rows that it makes."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pd.DataFrame({"symbol": pdf["id"] % 5, "date": pdf["id"], "score": pdf["id"] * 7919 % 401 / 4.0})

    return spark.range(rows).mapInPandas(make, "symbol long, date long, score double"), made


@pytest.mark.parametrize("bound", [10, 1_000])
def test_score_summary(spark, monkeypatch, bound):
    monkeypatch.setattr(scale, "MAX_GROUP_ROWS", bound)
    df, made = counted(spark)
    got = G.score_summary(df, "score", ["symbol", "date"]).first()
    score = pd.Series(np.arange(400) * 7919 % 401 / 4.0)
    assert (got["count"], got["min"], got["max"]) == (400, score.min(), score.max())
    assert [got[f"p{p}"] for p in (10, 25, 50, 75, 90)] == pytest.approx(score.quantile([0.1, 0.25, 0.5, 0.75, 0.9]).tolist())
    assert made.value == 400


@pytest.mark.parametrize("formats", [("parquet", "csv", "per_symbol_csv"), ("csv",), ("per_symbol_csv", "csv")])
def test_exports(spark, tmp_path, formats):
    df, made = counted(spark)
    S.export(df, str(tmp_path), formats)
    assert made.value == 400
    text = spark.read.option("header", "true").schema("symbol long, date long, score double")
    want = sorted(map(tuple, df.collect()))
    if "parquet" in formats:
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).collect())) == want
    if "csv" in formats:
        assert sorted(map(tuple, text.csv(str(tmp_path / "csv")).collect())) == want
    if "per_symbol_csv" in formats:
        assert sorted(map(tuple, text.option("recursiveFileLookup", "true").csv(str(tmp_path / "per_symbol")).collect())) == want


@pytest.mark.parametrize("gamma", [0.02, 0.5, 50.0])
def test_a_lasso_over_the_rows_takes_few_passes(spark, monkeypatch, gamma):
    """The same coefficients as from the cross products, in some twenty passes over the rows (by gradients alone some hundred)."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, size=(400, 3))
    y = 1.0 + x[:, 0] - 2 * x[:, 1] * x[:, 2] + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(3)
    direct = Z.fit_lasso(df, ["a", "b", "c"], "y", 1, gamma, refit=False)
    passes, summed = [], Z._summed
    monkeypatch.setattr(Z, "_summed", lambda *a: passes.append(1) or summed(*a))
    iterated = Z.fit_lasso(df, ["a", "b", "c"], "y", 1, gamma, refit=False, tolerance=1e-11, direct_terms=0)
    np.testing.assert_allclose(iterated.coefficients, direct.coefficients, atol=1e-8)
    assert np.array_equal(iterated.coefficients != 0, direct.coefficients != 0)
    assert len(passes) <= 40
