"""Run a named query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal

import duckdb

from ledgerlift.catalog import ORACLES, QUERIES
from ledgerlift.sources.derived import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, int, list]:
    """Row counts of both engines and the first rows that differ."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return len(left), -1, []
    quoted = ", ".join(f'"{c}"' for c in columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return len(left), -2, [(columns, sorted(names), quoted)]
    order = [names.index(c) for c in columns]
    right = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    types = [type(v) for v in left[0]] if left else []
    bad = [(a, b) for a, b in zip(left, right) if a != b][:2]
    if left and right and not bad and len(left) != len(right):
        bad = [("count", types)]
    return len(left), len(right), bad
