"""Compare registered queries with their SQL: ``python tests/compare.py DATA_FOLDER [QUERY ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("pages", "documents")


def normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences, empty when both sides agree in names, values and value types."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    expected = normal(result.fetchall(), names)
    actual = normal([tuple(r) for r in df.collect()], df.columns)
    if repr(expected) == repr(actual):
        return []
    found = [f"rows {len(actual)} != {len(expected)}"] if len(actual) != len(expected) else []
    columns = sorted(names)
    for a, e in zip(actual, expected):
        if repr(a) != repr(e):
            found.append("; ".join(f"{c}: {x!r} != {y!r}" for c, x, y in zip(columns, a, e) if repr(x) != repr(y)))
    return found


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from webgauge.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            df = build(spark, sf_dir)
            found = differences(df, con, sql[name]) if name in sql else [f"{df.count()} rows, no SQL"]
        except Exception as error:  # noqa: BLE001
            found = [f"failed: {str(error)[:400]}"]
        bad += bool(found) and name in sql
        print(name, f"{time.time() - begin:.1f}s", "OK" if not found else f"{len(found)} DIFF {found[0][:500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
