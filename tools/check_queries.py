"""Run registered queries and compare each with its SQL in DuckDB.

    python tools/check_queries.py [--sf /root/testdata/sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factorspark.catalog import ORACLES, QUERIES  # noqa: E402
from factorspark.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns sorted by name, as exact text, in sorted order."""
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        rows.append(tuple("NULL" if v is None or v is pd.NaT or v != v else repr(v.item() if hasattr(v, "item") else v) for v in row))
    return sorted(rows)


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "").replace("NaT", None)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(v) if hasattr(v, "isoformat") else v)
        elif str(df[c].dtype).startswith(("float", "Float")):
            df[c] = df[c].astype("float64")
        elif str(df[c].dtype).startswith(("int", "Int", "uint")):
            df[c] = df[c].astype(object)
    return df


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    a, b = canonical(normalise(spark_df)), canonical(normalise(sql_df))
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark, con = local_session(8), connect(opt.sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, fn in QUERIES.items():
        if opt.names and not any(name == n or name.startswith(n) for n in opt.names):
            continue
        start = time.time()
        try:
            got = fn(spark, opt.sf).toPandas()
            took = time.time() - start
            if name in ORACLES:
                wrong = differences(got, con.execute(ORACLES[name]).df())
            else:
                wrong = None if len(got) else "no rows"
        except Exception as e:  # report and go on with the next query
            took, wrong = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
            got = []
        failed += wrong is not None
        note = "" if name in ORACLES else " (no SQL)"
        print(f"{'FAIL' if wrong else 'ok  '} {name:34s} {len(got):8d} rows {took:6.2f}s{note} {wrong or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
