"""Compare a Spark result with DuckDB rows: names, count and values in any order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def assert_same(spark_df, relation) -> int:
    assert sorted(spark_df.columns) == sorted(relation.columns)
    spark_rows = _rows(spark_df.columns, spark_df.collect())
    duck_rows = _rows(relation.columns, relation.fetchall())
    assert len(spark_rows) == len(duck_rows)
    for left, right in zip(spark_rows, duck_rows):
        assert left == right
        assert [type(v) for v in left] == [type(v) for v in right]
    return len(spark_rows)
