"""A query's rows against its SQL in DuckDB, order and float noise aside."""

import math
import os
from collections import Counter

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def same_rows(frame, sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    theirs = Counter(repr(tuple(map(_plain, r))) for r in found.fetchall())
    ours = Counter(repr(tuple(map(_plain, r))) for r in frame.select(*[f"`{n}`" for n in names]).collect())
    assert ours == theirs
