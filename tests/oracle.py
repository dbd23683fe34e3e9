"""Compares a query's rows with its SQL's, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 50 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items(), key=str)) + "}"
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def rows_of_df(df):
    order = sorted(range(len(df.columns)), key=df.columns.__getitem__)
    return sorted(df.columns), sorted(tuple(plain(r[i]) for i in order) for r in df.collect())


def differences(df, con, sql):
    """"" if they agree, else what differs first."""
    (names, got), (wanted, want) = rows_of_df(df), rows_of_sql(con, sql)
    if names != wanted:
        return f"columns {names} and {wanted}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    return next((f"{g} and {w}" for g, w in zip(got, want, strict=True) if g != w), "")
