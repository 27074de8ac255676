"""Runs a query and its SQL on the same tables and compares rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def compare(df, db, sql: str) -> str:
    """'' if the rows agree, else what differs."""
    cols = sorted(df.columns)
    out = db.execute(sql)
    names = [c[0] for c in out.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()]
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(ours, key=key), sorted(theirs, key=key)
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
