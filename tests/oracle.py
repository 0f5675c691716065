"""Compare a bound query with its SQL text on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    rows.sort(key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return [columns[i] for i in order], rows


def compare(spark, con, name, bound, sf_dir, *, tolerance=1e-6):
    """None when equal, else a short text of the first difference."""
    started = time.time()
    df = bound.run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if bound.sql is None:
        return None if got else f"{name}: no rows", took, len(got)
    started = time.time()
    rel = con.execute(bound.sql)
    want_columns, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_columns != want_columns:
        return f"{name}: columns {got_columns} != {want_columns}", took, len(got)
    if len(got) != len(want):
        return f"{name}: {len(got)} rows, SQL has {len(want)}", took, len(got)
    for g, w in zip(got, want):
        for c, a, b in zip(got_columns, g, w):
            same = a == b
            if not same and isinstance(a, (int, float)) and isinstance(b, (int, float)):
                same = abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
            if not same:
                return f"{name}.{c}: {a!r} != {b!r} in {g} vs {w}", took, len(got)
    return None, took, len(got)
