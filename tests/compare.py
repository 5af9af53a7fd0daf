"""Run a query in Spark and its SQL in DuckDB and compare them as multisets."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = _rows(expected_columns, cursor.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    got = _rows(df.columns, df.collect())
    if got == expected:
        return None
    missing, extra = expected - got, got - expected
    return (
        f"{sum(got.values())} rows, expected {sum(expected.values())}; "
        f"missing {missing.total()} {list(missing)[:3]}; extra {extra.total()} {list(extra)[:3]}"
    )
