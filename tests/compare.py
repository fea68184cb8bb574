"""Run a checked query and its SQL counterpart and compare them as multisets of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter
from datetime import datetime

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows_by_name(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, db, query, sql: str, folder: str) -> tuple[int, int, int]:
    """Row count, rows only in Spark, rows only in SQL."""
    frame = query(spark, folder)
    left = rows_by_name(frame.columns, [tuple(r) for r in frame.collect()])
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    right = rows_by_name(columns, result.fetchall())
    assert sorted(frame.columns) == sorted(columns), (sorted(frame.columns), sorted(columns))
    return sum(left.values()), sum((left - right).values()), sum((right - left).values())
