"""Compares a query with its SQL on DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    try:
        return round(float(v), 6) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.select(*names).collect()), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if both agree."""
    (na, a), (nb, b) = spark_rows(df), sql_rows(con, sql)
    if na != nb:
        return f"columns {na} and {nb}"
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"rows {len(a)} and {len(b)}; only Spark: {only_a}; only SQL: {only_b}"
