"""Comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

# DuckDB type names and what Spark calls them.
TYPES = {
    "BIGINT": "bigint",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "DOUBLE": "double",
    "INTEGER": "int",
    "TIMESTAMP": "timestamp_ntz",
    "VARCHAR": "string",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs between a Spark result and that of `sql`; empty when nothing does."""
    mine = [tuple(row) for row in df.collect()]
    cursor = connection.execute(sql)
    columns = [entry[0] for entry in cursor.description]
    kinds = {entry[0]: TYPES.get(str(entry[1]), str(entry[1])) for entry in cursor.description}
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    wrong = {n: (k, kinds[n]) for n, k in df.dtypes if k != kinds[n]}
    if wrong:
        return f"types {wrong}"
    names = sorted(columns)
    mine = _by_name(mine, df.columns, names)
    theirs = _by_name(theirs, columns, names)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    unequal = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else ""


def _by_name(rows, columns, names):
    order = [columns.index(name) for name in names]
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)
