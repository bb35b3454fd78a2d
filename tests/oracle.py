"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows as multisets."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items()))
    return x


def duck(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def difference(query, sql, spark, folder):
    """'' if equal, else what differs."""
    df = query(spark, folder)
    names, rows = duck(sql, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(value(r[names.index(c)]) for c in order) for r in rows)
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
