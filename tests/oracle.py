"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if names, row counts and values agree."""
    ours, theirs = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"
    kinds = {
        n: (str(ours.schema.field(n).type), str(theirs.schema.field(n).type))
        for n in ours.column_names
    }
    unequal = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if unequal:
        return f"types {unequal}"
    left, right = _rows(ours), _rows(theirs)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else ""
