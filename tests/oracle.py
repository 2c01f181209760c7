"""Comparison of a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float | Decimal):
        value = float(value)
        return None if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, datetime | date):
        return str(value)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs, a few rows of each side; empty if nothing does."""
    found = con.sql(sql)
    if sorted(df.columns) != sorted(found.columns):
        return [f"columns {sorted(df.columns)} and {sorted(found.columns)}"]
    mine, other = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(found.columns, found.fetchall())
    out = [f"only in Spark: {r}"[:400] for r in list((mine - other).elements())[:3]]
    return out + [f"only in SQL: {r}"[:400] for r in list((other - mine).elements())[:3]]
