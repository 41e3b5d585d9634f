"""Runs registered queries against their SQL checks. ``python -m tests.compare [sf_dir] [name ...]``"""

from __future__ import annotations

import logging
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result; None when they are equal."""
    got_columns, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"first difference: {mine} != {theirs}"
    kinds = [{type(v).__name__ for v in column if v is not None} for column in zip(*got)]
    theirs = [{type(v).__name__ for v in column if v is not None} for column in zip(*want)]
    return None if kinds == theirs else f"types {kinds} != {theirs}"


def main() -> int:
    import __spark_entry__ as entry
    from spanferry.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    logging.disable(logging.CRITICAL)
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    failures = 0
    for name, run in entry.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        started = time.perf_counter()
        try:
            frame = run(spark, sf_dir)
            if name in checks:
                problem = difference(frame, con, checks[name])
            else:
                problem, count = None, frame.count()
                print(f"  rows only: {count}")
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.perf_counter() - started:.2f}s {problem or ''}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
