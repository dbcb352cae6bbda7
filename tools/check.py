"""Run registered queries and compare them with their SQL on the same tables.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from catalink.plans.catalogue import all_queries, all_sql  # noqa: E402
from catalink.session import build_session  # noqa: E402


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
            if isinstance(v, float) and v != v:
                return None
        if isinstance(v, float):
            return f"{v:.6f}".replace("-0.000000", "0.000000")
        if isinstance(v, int) and not isinstance(v, bool):
            return f"{v:.6f}"
        return str(v)

    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=str)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = normal(got), normal(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, first: {str(diff[0])[:600]}"
    return "ok"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(**{"spark.ui.showConsoleProgress": "false"})
    con = tables(sf_dir)
    queries, sql = all_queries(), all_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if name in sql:
                result = compare(got, con.execute(sql[name]).df())
            else:
                result = "ok (rows only)" if len(got) else "no rows"
        except Exception as error:  # report and go on with the next query
            result, got, took = f"{type(error).__name__}: {str(error)[:1500]}", [], time.time() - start
        bad += not result.startswith("ok")
        print(f"{name:32s} {len(got):8d} rows {took:6.1f}s sql {time.time() - start:5.1f}s  {result}",
              flush=True)
    print("failed:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
