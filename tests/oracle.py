"""Compare a query with its SQL, value by value."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb


def connect(data: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return (v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v).isoformat()
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, data, query, sql):
    df = query(spark, data)
    result = connect(data).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
