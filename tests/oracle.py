"""Compares registered queries with their SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

from notelake.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_cell(r[k]) for k in order) for r in rows), key=repr)


def difference(df, sql: str, con) -> str | None:
    """None if columns and rows agree; else what differs first."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; first ours {ours[:1]}, theirs {theirs[:1]}"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), None)
