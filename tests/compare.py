"""Compare every registered query with its SQL oracle: ``python -m tests.compare [sf] [key ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as contract

TESTDATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)
    rows = [
        tuple(None if v is None or v is pd.NA or v != v else (v.item() if hasattr(v, "item") else v) for v in row)
        for row in pdf[columns].astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def difference(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    left, right = canonical(spark_pdf), canonical(duck_pdf)
    if left == right:
        return None
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return f"{len(left)} vs {len(right)} rows; only spark {only_left}; only sql {only_right}"


def rows(df) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracle = contract.oracle_sql()
    wanted = sys.argv[2:] or list(contract.queries())
    failed = []
    for name in wanted:
        started = time.time()
        try:
            result = rows(contract.queries()[name](spark, sf_dir))
            took = time.time() - started
            if name not in oracle:
                print(f"rows {name} {len(result)} {took:.1f}s", flush=True)
                continue
            found = con.execute(oracle[name])
            expected = pd.DataFrame(
                found.fetchall(), columns=[d[0] for d in found.description], dtype=object
            )
            problem = difference(result, expected)
        except Exception as error:  # noqa: BLE001
            problem, took, result = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - started, []
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(result)} spark={took:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
