"""Run a query and its SQL over the same tables and compare them, order aside."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connection(root: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with a view for every table under `root`."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    """A value both engines write alike."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, Decimal):
        return str(v.normalize()) if v else "0"
    return str(v)


def rows(cols: list[str], data) -> list[tuple]:
    """Rows with their columns in the order of their names."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def both(spark, con, query, sql: str, root: str):
    """(Spark's column names and rows, DuckDB's)."""
    df = query(spark, root)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return (sorted(df.columns), rows(df.columns, df.collect())), (sorted(names), rows(names, cur.fetchall()))
