"""Side-by-side comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(repr(v)) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


KIND = {
    "bigint": "int64", "int": "int32", "smallint": "int16", "double": "double", "string": "string",
    "boolean": "bool", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts", "float": "float",
}
DUCK = {
    "BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "ts", "FLOAT": "float",
}


def compare(df, con, sql):
    """Return None when equal, else a short description of the difference."""
    rel = con.sql(sql)
    dtypes = {c: DUCK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    stypes = {c: KIND.get(t, t) for c, t in df.dtypes}
    if dtypes != stypes:
        diff = {k: (stypes.get(k), dtypes.get(k)) for k in set(dtypes) | set(stypes) if stypes.get(k) != dtypes.get(k)}
        return f"schema (spark, duckdb): {diff}"
    cols = sorted(dtypes)
    idx = [rel.columns.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in rel.fetchall()]
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    want.sort(key=key)
    got.sort(key=key)
    if want == got:
        return None
    ws, gs = set(want), set(got)
    return f"rows spark={len(got)} duckdb={len(want)} cols={cols}\n  only spark: {sorted(gs - ws, key=key)[:3]}\n  only duckdb: {sorted(ws - gs, key=key)[:3]}"
