"""Polynomial models whose systems are never formed, against the direct solution."""

import numpy as np
import pandas as pd
import pytest

from factorspark.operators import symbolic as Z


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(500, 3))
    y = 0.5 + x[:, 0] - 2 * x[:, 1] * x[:, 2] + 0.3 * x[:, 2] ** 2 + rng.normal(scale=0.2, size=500)
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(3)


def both(fit, *args, **how):
    return fit(*args, **how), fit(*args, **how, direct_terms=2)


def test_both_solvers_agree(small):
    direct, iterated = both(Z.fit_polynomial, small, ["a", "b", "c"], "y", 2)
    np.testing.assert_allclose(iterated.coefficients, direct.coefficients, atol=1e-7)
    direct, iterated = both(Z.fit_polynomial, small, ["a", "b", "c"], "y", 2, cutoff_p_value=0.01, max_terms=4)
    np.testing.assert_allclose(iterated.p_values, direct.p_values, atol=1e-7)
    assert np.count_nonzero(direct.coefficients) == 4
    np.testing.assert_allclose(iterated.coefficients, direct.coefficients, atol=1e-7)


@pytest.mark.parametrize("refit", [True, False])
def test_both_lassos_agree(small, refit):
    direct, iterated = both(Z.fit_lasso, small, ["a", "b", "c"], "y", 2, gamma=0.5, refit=refit)
    assert 0 < np.count_nonzero(direct.coefficients) < 10
    np.testing.assert_allclose(iterated.coefficients, direct.coefficients, atol=1e-6)


def test_missing_values_no_rows_and_dependent_terms(spark, small):
    holes = small.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)], small.schema))
    direct, iterated = both(Z.fit_polynomial, holes, ["a", "b", "c"], "y", 1)
    np.testing.assert_allclose(iterated.coefficients, direct.coefficients, atol=1e-7)
    np.testing.assert_allclose(direct.coefficients, Z.fit_polynomial(small, ["a", "b", "c"], "y", 1).coefficients, atol=1e-12)
    none = Z.fit_polynomial(small.limit(0), ["a", "b", "c"], "y", 1, direct_terms=2)
    assert (none.coefficients == 0).all()
    # A term that is 0 everywhere has no length and gets no weight.
    flat = small.selectExpr("a", "0.0 AS b", "y")
    direct, iterated = both(Z.fit_polynomial, flat, ["a", "b"], "y", 1)
    np.testing.assert_allclose(iterated.coefficients, direct.coefficients, atol=1e-7)
    with pytest.raises(ArithmeticError):
        Z.fit_polynomial(small, ["a", "b", "c"], "y", 3, direct_terms=2, steps=2)


def test_five_thousand_terms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 99))
    y = x[:, 0] * x[:, 1] - 3 * x[:, 2] + 0.5
    names = [f"x{i}" for i in range(99)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(8)
    model = Z.fit_polynomial(df, names, "y", 2, tolerance=1e-5)
    assert len(model.exponents) == 5050
    found = {e: c for e, c in zip(model.exponents, model.coefficients) if abs(c) > 1e-3}
    powers = {}
    for e, c in found.items():
        powers[tuple(i for i, n in enumerate(e) for _ in range(n))] = c
    assert set(powers) == {(), (2,), (0, 1)}
    assert powers[(2,)] == pytest.approx(-3, abs=1e-3) and powers[(0, 1)] == pytest.approx(1, abs=1e-3)
