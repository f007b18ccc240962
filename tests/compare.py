"""Run a query on Spark and its SQL on DuckDB; compare rows without order."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def data_dir(sf: str) -> str:
    return os.path.join("/root/testdata", sf)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return type(a) is type(b) and a == b


def compare(spark, query, sql: str, sf_dir: str, strict: bool = False) -> list[str]:
    """Problems found; ``strict`` asks for equal values, not equal to rounding."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    cur = con.execute(sql)
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    con.close()
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"]
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        lost = [r for r in want[1] if r not in set(got[1])][:3]
        return [f"rows {len(got[1])} != {len(want[1])}", f"only spark: {extra}", f"only sql: {lost}"]
    if got[1] == want[1]:
        return []
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    close = all(same(a, b) for a, b in bad)
    if close and not strict:
        return []
    return [f"{len(bad)} rows differ (close={close})", *[f"{a} | {b}" for a, b in bad[:3]]]
