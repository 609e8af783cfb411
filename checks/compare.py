"""Runs queries in both engines and compares them.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.registry import queries

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in GIVEN:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows as comparable tuples, columns by name, order ignored."""
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or (not isinstance(value, str) and pd.isna(value)):
            return "null"
        if isinstance(value, bool) or str(value) in ("True", "False"):
            return str(value)
        return repr(float(value)) if not isinstance(value, str) else value

    return sorted(tuple(plain(value) for value in row) for row in frame[columns].itertuples(index=False))


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    left, right = rows(spark_frame), rows(duck_frame)
    if len(left) != len(right):
        return f"{len(left)} / {len(right)} rows"
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        return f"{len(unequal)} rows differ, first:\n  {unequal[0][0]}\n  {unequal[0][1]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle = duck(sf_dir), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            result = query(spark, sf_dir).toPandas()
            middle = time.time()
            found = differences(result, connection.sql(oracle[name]).df())
            took = f"{len(result)} rows, {middle - start:.1f}s, twin {time.time() - middle:.1f}s"
        except Exception as error:  # noqa: BLE001 - report and go on with the others
            found, took = str(error)[:700], ""
        failed += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {took}", flush=True)
        if found is not None:
            print(found, flush=True)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]))
