"""Runs a query and its SQL and compares rows, order-free, columns by name."""

import math
from collections import Counter

import duckdb

from reachlake.plans.fixtures import TABLES


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return 0.0 if abs(float(v)) < 5e-7 else float(f"{float(v):.9g}") if math.isfinite(float(v)) else str(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(f"{v:.15g}")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(value(r[i]) for i in order) for r in data)


def oracle(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(sql)
    return rows([c[0] for c in r.description], r.fetchall())


def compare(spark, name, f, sql, sf):
    df = f(spark, sf)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = oracle(sql, sf)
    assert got_names == want_names, (name, got_names, want_names)
    if got != want:
        raise AssertionError(f"{name}: {sum(got.values())} rows, want {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}")
    return sum(got.values())
