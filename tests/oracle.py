"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(value):
    """A hashable value in which both engines agree."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, int):
        return round(float(value), 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    found = database(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def rows_of_frame(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> None:
    names, found = rows_of_frame(df)
    expected_names, expected = rows_of_sql(sql, sf_dir)
    assert names == expected_names
    lost, extra = expected - found, found - expected
    assert not lost and not extra, f"missing {sum(lost.values())}: {list(lost)[:3]}; extra {sum(extra.values())}: {list(extra)[:3]}"
