"""Compare every registered query with its DuckDB counterpart.

    python tests/compare.py [data folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(spark, connection, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty when both engines agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = connection.sql(sql)
    want = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} vs {sorted(result.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows, first {bad[0]}" if bad else ""


def main() -> None:
    import __spark_entry__ as registry
    from tests.conftest import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    connection, oracles = duck(sf_dir), registry.oracle_sql()
    wanted = sys.argv[2:] or list(registry.queries())
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, connection, name, registry.queries()[name], oracles[name], sf_dir)
            else:
                registry.queries()[name](spark, sf_dir).collect()
                problem = ""
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
