"""Compare registered queries with their SQL: `python tests/compare.py SF_DIR [name ...]`."""

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name):
    """(rows, seconds, sql seconds, what differs or None)"""
    start = time.time()
    df = E.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in E.oracle_sql():
        return len(got), took, 0.0, None
    start = time.time()
    rel = con.sql(E.oracle_sql()[name])
    want = rows_of(rel.columns, rel.fetchall())
    sql_took = time.time() - start
    if sorted(df.columns) != sorted(rel.columns):
        return len(got), took, sql_took, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:1] if len(got) < 50000 else []
        lacking = [r for r in want if r not in set(got)][:1] if len(got) < 50000 else []
        return len(got), took, sql_took, f"{len(got)} rows, {len(want)} in SQL; extra {extra}, lacking {lacking}"
    return len(got), took, sql_took, None


def main():
    from tests.session import make_session

    sf, names = sys.argv[1], sys.argv[2:] or list(E.queries())
    spark = make_session()
    con = connect(sf)
    for name in names:
        try:
            n, took, sql_took, diff = compare(spark, con, sf, name)
        except Exception as e:
            n, took, sql_took, diff = -1, 0, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql" if name in E.oracle_sql() else "rows"
        print(f"{'ok  ' if diff is None else 'DIFF'} {name:24} {kind:5} rows={n} spark={took:.1f}s sql={sql_took:.1f}s", diff or "", flush=True)


if __name__ == "__main__":
    main()
