"""The affine scan of exponential means against pandas, with chunks of any size."""

import numpy as np
import pandas as pd
import pytest

from factorspark.functions.rolling import Frames
from factorspark.plans import operators as O


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for symbol, n in (("a", 700), ("b", 1), ("c", 90), ("d", 300)):
        x = rng.normal(size=n).cumsum() + 50
        x[rng.random(n) < 0.3] = np.nan
        if symbol == "a":
            x[100:400] = np.nan  # a gap of several chunks
        if symbol == "c":
            x[:20] = np.nan
        if symbol == "d":
            x[:] = 3.25
        out.append(pd.DataFrame({"symbol": symbol, "date_idx": range(n), "x": x}))
    return pd.concat(out)


@pytest.mark.parametrize("span", [1, 2, 3, 10, 60, 500])
@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_equals_pandas(spark, rows, monkeypatch, span, chunk):
    monkeypatch.setattr(O, "EMA_CHUNK", chunk)
    df = spark.createDataFrame([(s, int(i), None if np.isnan(x) else float(x)) for s, i, x in rows.itertuples(index=False)], "symbol string, date_idx int, x double")
    out = O.recursive_ema(df, "x", span, "e", Frames())
    assert out.columns == ["symbol", "date_idx", "x", "e"]
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values(["symbol", "date_idx"])["e"].to_numpy(float)
    want = rows.groupby("symbol")["x"].transform(lambda s: s.ewm(span=span, adjust=False, min_periods=1).mean()).to_numpy(float)
    np.testing.assert_allclose(got, want, rtol=1e-11)
