"""Compares a query with its SQL: column names, rows without order, floats to a few ulps."""

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.10g}") + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def compare(df, con, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns, (names, columns)
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got)
