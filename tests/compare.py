"""Compare a Spark result with DuckDB's result of the equal SQL."""

from __future__ import annotations

import math
from glob import glob
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(round(v, 6) + 0.0, ".6f")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when both agree in columns, row count and values, else a short description."""
    table = df.toArrow()
    ours = rows_of(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else [])
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if not bad:
        return None
    return f"{len(bad)} of {len(ours[1])} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
