"""A query's rows beside those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = Path("/root/testdata/sf0.001")


def _text(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in rows)


def both(spark, query, sql: str, folder: Path = TABLES):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.sql(sql)
    df = query(spark, str(folder))
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(found.columns, found.fetchall())
