"""Compare a registered query with its SQL oracle: same columns, rows and values."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return f"{value + 0.0:.9g}" if value != value else repr(value + 0.0)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_plain(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found; an empty list means the results match."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    oracle_rows = cursor.fetchall()
    spark_rows = spark_df.collect()
    spark_names = spark_df.columns
    if sorted(names) != sorted(spark_names):
        return [f"columns {sorted(spark_names)} != {sorted(names)}"]
    problems = []
    if len(oracle_rows) != len(spark_rows):
        problems.append(f"rows spark {len(spark_rows)} oracle {len(oracle_rows)}")
    order = sorted(names)
    left = sorted(tuple(_plain(row[c]) for c in order) for row in spark_rows)
    at = {name: i for i, name in enumerate(names)}
    right = sorted(tuple(_plain(row[at[c]]) for c in order) for row in oracle_rows)
    if left != right:
        only_left = sorted(set(left) - set(right))[:2]
        only_right = sorted(set(right) - set(left))[:2]
        problems.append(f"values differ ({order}): spark {only_left} oracle {only_right}")
    return problems
