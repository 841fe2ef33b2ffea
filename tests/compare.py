"""Spark result against DuckDB result: same columns, same rows in any order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter


def views(d: str):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def differ(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(norm(x) for x in t) for t in (tuple(row[names.index(n)] for n in order) for row in r.fetchall()))
    got = Counter(tuple(norm(x) for x in (row[n] for n in order)) for row in df.collect())
    if want == got:
        return ""
    return f"{order}: rows {sum(got.values())} against {sum(want.values())}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
