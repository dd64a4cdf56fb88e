"""Compare a registered query with its SQL twin by name, count and value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


FAMILY = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
          "boolean": "BOOLEAN", "int": "INTEGER"}


def differences(spark: SparkSession, con, sf_dir: str, query, sql: str) -> list[str]:
    """What differs; empty when both give the same columns, types and rows."""
    frame = query(spark, sf_dir)
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    kinds = {d[0]: str(d[1]) for d in theirs.description}
    found = []
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} and {sorted(names)}"]
    for name, kind in frame.dtypes:
        if FAMILY.get(kind) != kinds[name]:
            found.append(f"type of {name}: {kind} and {kinds[name]}")
    ours = _bag(frame.columns, frame.collect())
    other = _bag(names, theirs.fetchall())
    if ours != other:
        found.append(
            f"rows {ours.total()} and {other.total()}; "
            f"only ours {list((ours - other).items())[:2]}; "
            f"only theirs {list((other - ours).items())[:2]}"
        )
    if not ours:
        found.append("no rows")
    return found
