"""Rows of a query held against DuckDB SQL over the same tables."""

import math
import os

import duckdb


def compare(df, sql, sf, digits=6):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, str(round(x, digits) + 0.0) if isinstance(x, float) and math.isfinite(x) else str(x)) for x in r)
    rows = sorted(key(r) for r in want.fetchall())
    got = sorted(key(tuple(r[n] for n in names)) for r in df.collect())
    assert sorted(names) == sorted(df.columns)
    assert len(rows) == len(got)
    for a, b in zip(got, rows, strict=True):
        assert a == b
