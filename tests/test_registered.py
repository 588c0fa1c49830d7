"""Metrics and table functions that a user registers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.operators import fitness as N
from factorspark.operators import quality as V


def test_numpy_metric_by_group(spark):
    N.register_sums_metric("mean gap", lambda y, p, w: [w.sum(), (w * (p - y)).sum()], lambda s: s[1] / s[0] if s[0] else np.nan, 2, False)
    rows = [("a", None, 1.0, 2.0), ("a", None, 1.0, 4.0), ("b", 1, 5.0, 4.0), ("b", 1, None, 9.0), ("c", 2, None, 1.0), (None, 3, 2.0, 2.5)]
    df = spark.createDataFrame(rows, "g string, _k0 int, y double, p double").repartition(3)
    out = {r[0]: (r["mean gap"], r["mse"]) for r in N.grouped_metrics(df, ["mean gap", "mse"], ["g"]).collect()}
    assert out == {"a": (2.0, 5.0), "b": (-1.0, 1.0), "c": (None, None), None: (0.5, 0.25)}
    two = N.grouped_metrics(df, ["mean gap"], ["g", "_k0"]).collect()
    assert {(r["g"], r["_k0"]): r["mean gap"] for r in two} == {("a", None): 2.0, ("b", 1): -1.0, ("c", 2): None, (None, 3): 0.5}
    assert N.grouped_metrics(df.limit(0), ["mean gap"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        N.grouped_metrics(df, ["spearman"], ["g"])
    with pytest.raises(ValueError):
        N.register_sums_metric("mse", None, None, 1, False)


def test_formula_table(spark):
    V.register_formula_table(spark)
    spark.createDataFrame([("Mean( close , 5d )",), ("Add($open,",), (None,), ("",)], "line string").createOrReplaceTempView("written")
    rows = spark.sql("SELECT line, i.* FROM written, LATERAL formula_info(line) i").orderBy(F.col("line").desc_nulls_last()).collect()
    assert [(r["valid"], r["canonical"], r["features"], r["longest_window"]) for r in rows] == [
        (True, "Mean($close,5d)", ["close"], 5), (False, None, None, None), (False, None, None, None), (False, None, None, None)
    ]
    assert all(r["fault"] for r in rows[1:])
