"""Runs registered queries in Spark and their SQL in DuckDB and compares rows.

    python tests/parity.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf, f"{name}.parquet")
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, db, sql: str) -> str | None:
    """A description of how results differ, or None where they agree."""
    table = spark_df.toArrow()
    spark_columns = table.column_names
    found = _rows(spark_columns, zip(*[c.to_pylist() for c in table.columns]))
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(spark_columns):
        return f"columns {sorted(spark_columns)} against {sorted(columns)}"
    expected = _rows(columns, result.fetchall())
    if found == expected:
        return None
    extra, missing = found - expected, expected - found
    return (
        f"{found.total()} rows against {expected.total()}, {extra.total()} differ: "
        f"{list(extra)[:3]} against {list(missing)[:3]}"
    )


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from glotsieve.session import build_session, clear_scratch

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(sf), 0
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            sql = oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only: {df.count()}"
                spark_time = time.time() - start
                sql_time = 0.0
            else:
                df = spark.createDataFrame(df.toArrow())
                spark_time = time.time() - start
                verdict = differences(df, db, sql)
                sql_time = time.time() - start - spark_time
                failed += verdict is not None
        except Exception as error:  # report and go on with the next query
            verdict, failed = f"{type(error).__name__}: {str(error)[:600]}", failed + 1
            spark_time, sql_time = time.time() - start, 0.0
        print(f"{name:24s} {spark_time:6.1f}s {sql_time:6.1f}s {verdict or 'ok'}", flush=True)
    clear_scratch(spark)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
