"""Runs registered queries against their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "\0"
        if isinstance(value, float):
            return repr(value)
        return f"{type(value).__name__}:{value}"

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when the results agree, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)} rows"
    left, right = canonical(got, df.columns), canonical(want, names)
    for a, b in zip(left, right):
        if a != b:
            return f"{a}\n{b}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        if name not in oracles:
            print(f"--  {name} has no SQL", flush=True)
            continue
        started = time.time()
        try:
            problem = difference(spark, con, sf_dir, query, oracles[name])
        except Exception as error:  # report it and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.2f}s "
              f"{problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
