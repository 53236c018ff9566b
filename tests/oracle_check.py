"""Run a query in Spark and its SQL twin in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql: str):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def differences(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows / {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{str(a)[:300]} / {str(b)[:300]}"
    return None


def main(sf_dir: str, only: list[str]) -> None:
    import __spark_entry__ as entry
    from insight_spark import build_session

    if "--plain" in only:  # a session without any of our settings
        from pyspark.sql import SparkSession

        only = [part for part in only if part != "--plain"]
        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = build_session("oracle check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and not any(name.startswith(part) for part in only):
            continue
        start = time.time()
        try:
            result = spark_rows(run(spark, sf_dir))
            took = time.time() - start
            if name not in oracles:
                note = f"rows only: {len(result[1])}"
            else:
                start = time.time()
                wrong = differences(result, duck_rows(connection, oracles[name]))
                note = f"DIFF {wrong}" if wrong else f"ok {len(result[1])} rows (sql {time.time() - start:.1f}s)"
                bad += bool(wrong)
        except Exception as problem:
            took = time.time() - start
            note, bad = f"ERROR {type(problem).__name__}: {str(problem)[:600]}", bad + 1
        print(f"{name:28s} {took:6.2f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
