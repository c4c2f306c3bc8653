"""Run registered queries next to their SQL oracles and report differences."""

from __future__ import annotations

import math
from typing import Any

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value: Any) -> Any:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    return value


def _sorted(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def spark_result(spark: SparkSession, query, sf_dir: str) -> tuple[list[str], list[tuple]]:
    df = query(spark, sf_dir)
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def oracle_result(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return _sorted(columns, cursor.fetchall())


def difference(spark_side: tuple, oracle_side: tuple) -> str | None:
    """None if equal, else a short description of the first difference."""
    if spark_side[0] != oracle_side[0]:
        return f"columns {set(spark_side[0]) ^ set(oracle_side[0])}"
    if len(spark_side[1]) != len(oracle_side[1]):
        return f"rows {len(spark_side[1])} vs {len(oracle_side[1])}"
    for mine, theirs in zip(spark_side[1], oracle_side[1]):
        if mine != theirs:
            cells = [(c, a, b) for c, a, b in zip(spark_side[0], mine, theirs) if a != b]
            return f"values {cells[:4]}"
    return None
