"""Compares a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def differs(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    b = rows([d[0] for d in got.description], got.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} {len(b[1])}"
    return next((f"{x} {y}" for x, y in zip(a[1], b[1]) if x != y), "")
