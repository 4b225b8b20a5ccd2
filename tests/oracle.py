"""Runs registered queries beside their SQL twins and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return int(v) if v.is_integer() and abs(v) < 2**53 else float(f"{v:.10g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("decimal", "double", "float")):
        return "number"
    if t in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint"):
        return "integer"
    if t.startswith("timestamp"):
        return "timestamp"
    return {"string": "text", "varchar": "text", "boolean": "boolean", "date": "date"}.get(t, t)


def compare(df, relation) -> str | None:
    """What differs, or None."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = rows_of(relation.columns, relation.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    types = {n: kind(t) for n, t in df.dtypes}
    twin = {n: kind(str(t)) for n, t in zip(relation.columns, relation.types)}
    if types != twin:
        return f"types { {n: (types[n], twin[n]) for n in types if types[n] != twin[n]} }"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} / {sum(want.values())} rows; only here {list(extra.items())[:3]}; "
            f"only in SQL {list(missing.items())[:3]}"
        )
    return None
