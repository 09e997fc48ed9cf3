"""SQL text for PostgreSQL and SQL Server targets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

from tablefeed.functions.text import (
    MARKER_KEEP,
    MARKER_LABEL,
    timestamp_text,
    zoned_timestamp_text,
)
from tablefeed.specs import TableSpec


class UnsupportedType(TypeError):
    """A column type the target cannot take."""


@dataclass(frozen=True)
class Dialect:
    """How a database writes names, types and the statements of a load.

    ``types`` and ``staging_types`` go by Spark type name; ``{p}`` and ``{s}``
    stand for a decimal's precision and scale.
    """

    name: str
    quotes: tuple[str, str]
    types: dict[str, str]
    staging_types: dict[str, str]
    concat: str
    staged: bool
    nullable: str
    staging_table: str
    create_if_absent: Callable[[str, str, str], str]
    upsert: Callable[[Dialect, TableSpec, str, str], str]
    time_text: Callable[[dt.datetime], str] = timestamp_text

    def quote(self, name: str) -> str:
        start, end = self.quotes
        return start + name.replace(end, end * 2) + end

    def quoted(self, names: list[str] | tuple[str, ...], prefix: str = "") -> str:
        return ", ".join(prefix + self.quote(n) for n in names)

    def type_of(self, data_type: T.DataType, staging: bool = False) -> str:
        name = data_type.typeName()
        known = {**self.types, **self.staging_types} if staging else self.types
        if name not in known:
            raise UnsupportedType(f"{self.name} has no column type for {data_type.simpleString()}")
        if isinstance(data_type, T.DecimalType):
            return known[name].format(p=data_type.precision, s=data_type.scale)
        return known[name]

    # -- statements -----------------------------------------------------------

    def create_table(self, spec: TableSpec) -> str:
        columns = [
            f"{self.quote(f.name)} {self.type_of(f.dataType)}"
            f"{self.nullable if f.nullable else ' NOT NULL'}"
            for f in spec.schema
        ]
        body = f"{', '.join(columns)}, PRIMARY KEY ({self.quoted(spec.pk)})"
        return self.create_if_absent(spec.name, self.quote(spec.name), body)

    def create_staging(self, spec: TableSpec, staging: str) -> str:
        columns = [
            f"{self.quote(f.name)} {self.type_of(f.dataType, staging=True)}" for f in spec.schema
        ]
        return f"{self.staging_table} {self.quote(staging)} ({', '.join(columns)})"

    def drop(self, table: str) -> str:
        return f"DROP TABLE IF EXISTS {self.quote(table)}"

    def truncate(self, table: str) -> str:
        return f"TRUNCATE TABLE {self.quote(table)}"

    def typed_columns(self, spec: TableSpec) -> str:
        """The staged columns as the target's types; text never converts by itself."""

        def one(field: T.StructField) -> str:
            name = self.quote(field.name)
            target = self.type_of(field.dataType)
            if self.type_of(field.dataType, staging=True) == target:
                return name
            return f"CAST({name} AS {target}) AS {name}"

        return ", ".join(one(field) for field in spec.schema)

    def copy_staged(self, spec: TableSpec, staging: str) -> str:
        return (
            f"INSERT INTO {self.quote(spec.name)} ({self.quoted(spec.columns)}) "
            f"SELECT {self.typed_columns(spec)} FROM {self.quote(staging)}"
        )

    def assignments(self, spec: TableSpec, source: str, now_text: str) -> str:
        """Every column but the key from the incoming row, its comment marked."""
        label = (MARKER_LABEL + now_text).replace("'", "''")
        values = {c: f"{source}.{self.quote(c)}" for c in spec.payload}
        if spec.comment in values:
            values[spec.comment] = (
                f"LEFT({values[spec.comment]}, {MARKER_KEEP}) {self.concat} '{label}'"
            )
        return ", ".join(f"{self.quote(c)} = {v}" for c, v in values.items())

    def upsert_staged(self, spec: TableSpec, staging: str, now_text: str) -> str:
        return self.upsert(self, spec, staging, now_text)


def _on_conflict(d: Dialect, spec: TableSpec, staging: str, now_text: str) -> str:
    updates = d.assignments(spec, "EXCLUDED", now_text)
    action = f"DO UPDATE SET {updates}" if updates else "DO NOTHING"
    return f"{d.copy_staged(spec, staging)} ON CONFLICT ({d.quoted(spec.pk)}) {action}"


def _merge(d: Dialect, spec: TableSpec, staging: str, now_text: str) -> str:
    matches = " AND ".join(f"old.{d.quote(c)} = new.{d.quote(c)}" for c in spec.pk)
    updates = d.assignments(spec, "new", now_text)
    matched = f"WHEN MATCHED THEN UPDATE SET {updates} " if updates else ""
    return (
        f"MERGE INTO {d.quote(spec.name)} AS old "
        f"USING (SELECT {d.typed_columns(spec)} FROM {d.quote(staging)}) AS new ON {matches} "
        f"{matched}WHEN NOT MATCHED THEN INSERT ({d.quoted(spec.columns)}) "
        f"VALUES ({d.quoted(spec.columns, 'new.')});"
    )


# Column types by Spark type name.
POSTGRESQL = Dialect(
    name="PostgreSQL",
    quotes=('"', '"'),
    types={
        "integer": "INTEGER",
        "long": "BIGINT",
        "float": "REAL",
        "double": "DOUBLE PRECISION",
        "string": "TEXT",
        "date": "DATE",
        "decimal": "NUMERIC({p},{s})",
    },
    staging_types={},
    concat="||",
    staged=True,
    nullable="",
    staging_table="CREATE UNLOGGED TABLE",
    create_if_absent=lambda _, quoted, body: f"CREATE TABLE IF NOT EXISTS {quoted} ({body})",
    upsert=_on_conflict,
    time_text=zoned_timestamp_text,
)

SQL_SERVER = Dialect(
    name="SQL Server",
    quotes=("[", "]"),
    types={
        "integer": "INT",
        "long": "BIGINT",
        "float": "REAL",
        "double": "FLOAT",
        "string": "NVARCHAR(MAX)",
        "date": "DATE",
        "decimal": "DECIMAL({p}, {s})",
    },
    staging_types={"date": "NVARCHAR(10)", "decimal": "NVARCHAR(40)"},
    concat="+",
    staged=True,
    nullable=" NULL",
    staging_table="CREATE TABLE",
    create_if_absent=lambda name, quoted, body: (
        "IF OBJECT_ID(N'{}', 'U') IS NULL CREATE TABLE {} ({})".format(
            quoted.replace("'", "''"), quoted, body
        )
    ),
    upsert=_merge,
)
