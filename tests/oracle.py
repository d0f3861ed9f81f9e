"""Run a query and its check SQL side by side."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    cur = con.execute(sql)
    theirs = _rows([d[0] for d in cur.description], cur.fetchall())
    ours = _rows(df.columns, df.collect())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] == theirs[1]:
        return None
    ours_set, theirs_set = set(ours[1]), set(theirs[1])
    only_ours = [r for r in ours[1] if r not in theirs_set][:3]
    only_theirs = [r for r in theirs[1] if r not in ours_set][:3]
    return f"rows {len(ours[1])} vs {len(theirs[1])}; ours {only_ours}; theirs {only_theirs}"
