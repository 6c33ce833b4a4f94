"""Runs queries against their DuckDB statements: same columns, same rows, order aside."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """"" if equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {sorted(columns)} and {names}"
    order = [columns.index(c) for c in names]
    theirs = Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    if mine == theirs:
        return ""
    only, other = list((mine - theirs).elements()), list((theirs - mine).elements())
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {len(only)} {only[:2]}; only there {len(other)} {other[:2]}"
