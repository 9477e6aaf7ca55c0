"""Compares a named query with its checking SQL: columns, row count and every value."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from suitegauge.sources.tables import SCHEMAS


def engine(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT:
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False))


def differences(spark_frame: pd.DataFrame, checked: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(checked.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(checked.columns)}"
    a, b = rows(spark_frame), rows(checked)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for left, right in zip(a, b):
        if left != right:
            return f"{left} against {right}"
    return None
