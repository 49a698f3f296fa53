"""Compare every query with its DuckDB counterpart: ``python -m workload.check [sf] [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from workload.oracles import ORACLES
from workload.registry import QUERIES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)].astype(object)
    text = frame.where(frame.notna(), "<null>").map(str)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> str:
    """'' when the results are equal, else what is not."""
    got = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLES:
        return "" if len(got) else "no rows"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        return f"{wrong.sum()} rows differ, first:\n{a[wrong].head(2)}\n{b[wrong].head(2)}"
    return "" if len(got) else "no rows"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    data = f"/root/testdata/sf{sf}"
    failed = 0
    for query in sys.argv[2:] or QUERIES:
        start = time.perf_counter()
        try:
            problem = differences(session, duck(data), data, query)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{query}: {problem or 'ok'} ({time.perf_counter() - start:.1f}s)", flush=True)
    print(f"{failed} failed of {len(sys.argv[2:] or QUERIES)}")
