"""Comparing a query with its SQL in DuckDB, rows in any order.

Run as a script to check queries on a data folder:  python tests/compare.py FOLDER [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def kind(v):
    return "int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple((kind(r[i]), plain(r[i])) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, folder, query, sql, con=None):
    """Returns None when equal, else a text that says what differs."""
    df = query(spark, folder)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    con = con or connect(folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {sorted(df.columns)}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tillage.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, folder, queries[n], sql.get(n), con)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {n} {time.time() - t:.2f}s {'' if n in sql else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
