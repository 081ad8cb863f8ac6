"""Runs a query and its SQL side by side and compares their rows."""

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = p + "/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x + 0.0:.12g}")
    return x


def same(df, sql: str, sf_dir: str) -> None:
    got = duck(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in got.fetchall())
    have = sorted(repr(tuple(plain(x) for x in r)) for r in df.collect())
    assert len(have) == len(want)
    different = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not different, different[:3]
