"""Comparing rows of a query with those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SMALL = Path("/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return None if v != v else "inf" if math.isinf(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same_as_sql(spark, f, sql, folder=SMALL) -> tuple[list, list]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = f(spark, str(folder))
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    return a, b
