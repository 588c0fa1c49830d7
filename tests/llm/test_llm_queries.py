"""Every registered query against its SQL; the pipeline's queries too."""

import glob
import os

import duckdb
import pytest

from factorspark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
    assert got == want


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
