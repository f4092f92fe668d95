"""Comparing a query with its SQL, value by value."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def differing(spark, run, sql, folder=FOLDER):
    """Rows that only one of the two has, after a check of the column names."""
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = Counter(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3]
