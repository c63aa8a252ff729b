"""Run registered queries against DuckDB and compare all rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__ if isinstance(x, bool) else ""), str(x)) for x in row)


def _norm(rows):
    out = [tuple(_cell(c) for c in r) for r in rows]
    out = [tuple(float(c) if isinstance(c, int) and not isinstance(c, bool) else c for c in r) for r in out]
    return sorted(out, key=_key)


def compare(spark, con, sf_dir, key, fn, sql):
    """None if equal, else a description."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}", len(got), t1 - t0
    exp = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall()
    a, b = _norm(got), _norm(exp)
    if a == b:
        return None, len(got), t1 - t0
    sa, sb = set(a), set(b)
    return (f"rows {len(a)} vs {len(b)}; cols {cols}; only spark {sorted(sa - sb, key=_key)[:3]}; "
            f"only duckdb {sorted(sb - sa, key=_key)[:3]}"), len(got), t1 - t0
