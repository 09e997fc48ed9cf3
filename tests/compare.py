"""Run a query and its SQL, and compare columns, types and rows in any order."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    return value


def rows_by_name(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


# Spark type name: the type names that hold the same values.
SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "date": {"DATE"},
}


def differences(actual: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    types = dict(zip(names, (str(column[1]) for column in result.description)))
    found = []
    if sorted(names) != sorted(actual.columns):
        return [f"columns {sorted(actual.columns)} != {sorted(names)}"]
    for field in actual.schema:
        spark_type = field.dataType.simpleString()
        if types[field.name] not in SAME_TYPE.get(spark_type, {types[field.name]}):
            found.append(f"{field.name}: {spark_type} != {types[field.name]}")
    want = rows_by_name(names, result.fetchall())
    got = rows_by_name(actual.columns, [tuple(row) for row in actual.collect()])
    if len(want) != len(got):
        found.append(f"{len(got)} rows, expected {len(want)}")
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        found.append(f"{len(different)} rows differ, first {different[0]}")
    return found
