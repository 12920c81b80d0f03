"""Run a registered query and its SQL twin, and compare the rows by value."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, con, sf_dir: str, query, sql: str, show: int = 3) -> list[str]:
    """What differs between the Spark result and the SQL result, as text; empty if nothing does."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)} rows"]
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        return [f"{len(unequal)} of {len(ours)} rows differ"] + [f"{a}\n    {b}" for a, b in unequal[:show]]
    return []
