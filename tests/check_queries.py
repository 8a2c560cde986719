"""Run registered queries and compare each with its SQL: python -m tests.check_queries FOLDER [NAME ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry_points
from tests.session import local_session
from vestigo.sources.tables import scope

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def database(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def key(value):
        return (value is None, "nan" if isinstance(value, float) and math.isnan(value) else value)
    return [columns[i] for i in order], sorted(([r[i] for i in order] for r in rows), key=lambda r: [key(v) for v in r])


def difference(spark, con, folder: str, name: str):
    """None when query and SQL agree exactly, else a short description; also the number of rows and seconds."""
    start = time.time()
    with scope(spark):
        frame = entry_points.queries()[name](spark, folder)
        got = frame.collect()
    seconds = time.time() - start
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return (None if got else "no rows"), len(got), seconds
    result = con.execute(sql)
    columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    have_columns, have = rows_of(frame.columns, [tuple(r) for r in got])
    if columns != have_columns:
        return f"columns {have_columns} instead of {columns}", len(got), seconds
    if len(want) != len(have):
        return f"{len(have)} rows instead of {len(want)}", len(got), seconds
    for a, b in zip(have, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = sum(x != y for x, y in zip(have, want))
            return f"{bad} rows differ, first {str(a)[:300]} instead of {str(b)[:300]}", len(got), seconds
    kinds = dict(zip([d[0] for d in result.description], [str(d[1]) for d in result.description]))
    odd = [(n, t, kinds[n]) for n, t in frame.dtypes if SAME.get(t) != kinds[n]]
    return (f"types {odd}" if odd else None), len(got), seconds


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def main(folder: str, *names: str) -> int:
    spark, con, bad = local_session(), database(folder), 0
    for name in names or entry_points.queries():
        try:
            problem, rows, seconds = difference(spark, con, folder, name)
        except Exception as error:
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:600]}", 0, 0
            if os.environ.get("RAISE"):
                raise
        bad += problem is not None
        kind = "sql " if name in entry_points.oracle_sql() else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {kind} {name:26} {rows:8} rows {seconds:7.2f} s  {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
