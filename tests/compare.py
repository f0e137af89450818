"""Run a query and its SQL counterpart on the same files and compare the whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def sql_connection(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _normal(value):
    if isinstance(value, bool):
        return int(value)
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return float(value) + 0.0
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(frame, sql: str, connection, shown: int = 3) -> list[str]:
    cursor = connection.execute(sql)
    sql_columns = [d[0] for d in cursor.description]
    if sorted(frame.columns) != sorted(sql_columns):
        return [f"columns {sorted(frame.columns)} != {sorted(sql_columns)}"]
    ours = _sorted_rows(frame.columns, frame.collect())
    theirs = _sorted_rows(sql_columns, cursor.fetchall())
    problems = [] if len(ours) == len(theirs) else [f"{len(ours)} rows != {len(theirs)} rows"]
    different = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ")
        problems += [f"{a} != {b}" for a, b in different[:shown]]
    return problems
