"""Ranks of several columns over tables that outgrow one task."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import fitness as N
from factorspark.operators import scale
from factorspark.session import checkpoint_dir


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("broadcast", [5, 100_000])
def test_average_ranks_of_columns(spark, monkeypatch, wide, broadcast):
    """Ties, missing values and groups, in one window and by counted values, joined by broadcast or shuffle."""
    if wide:
        monkeypatch.setattr(scale, "MAX_GROUP_ROWS", 3)
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", broadcast)
    rows = [(k, None if k % 50 == 7 else k % 3, float(k * 7919 % 40) if k % 11 else None, k * 31 % 300 / 8.0 * (-1) ** k, -0.0 if k % 2 else 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, zero double").repartition(5)
    pdf = pd.DataFrame(rows, columns=["id", "g", "a", "b", "zero"])
    for by in ([], ["g"]):
        got = scale.average_rank(df, by, {"a": "ra", "b": "rb", "zero": "rz"}).toPandas().sort_values("id").reset_index(drop=True)
        assert len(got) == 300
        source = pdf.groupby("g", dropna=False) if by else pdf
        for c, r in (("a", "ra"), ("b", "rb"), ("zero", "rz")):
            pd.testing.assert_series_equal(got[r], source[c].rank() - 1, check_names=False)


def test_ranked_programs_store_rows_a_few_times(spark, monkeypatch):
    """Twelve programs: the rows are not written anew for each of them."""
    monkeypatch.setattr(scale, "MAX_GROUP_ROWS", 100)

    def written():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(checkpoint_dir(spark).removeprefix("file:")) for f in files)

    n = 30_000
    df = spark.range(n).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 7.0).alias(f"x{i}") for i in range(12)], (F.xxhash64("id", F.lit(99)) / 1e12).alias("y"))
    before = written()
    got = N.decorrelated_programs(df, {f"X{i}": F.col(f"x{i}") for i in range(12)}, "y", 9, 4, True).collect()
    assert len(got) == 4 and written() - before < 3 * 13 * 8 * n
    pdf = df.toPandas().rank()
    want = pdf.corr()["y"].abs()
    assert got[0]["fitness"] == pytest.approx(want.drop("y").max(), abs=1e-12)
