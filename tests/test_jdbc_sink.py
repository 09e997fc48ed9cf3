"""Statements for databases. No server is started: the text is checked as text, and what
another SQL engine understands of it is run there, in place of a JDBC connection."""

import dataclasses
import datetime as dt

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tablefeed.operators.batches import GeneratedChanges
from tablefeed.plans.cdc import Feed, apply_batches
from tablefeed.plans.rates import Pace
from tablefeed.plans.snapshot import generated_loads, run_snapshot
from tablefeed.sinks.dialects import POSTGRESQL, SQL_SERVER, UnsupportedType
from tablefeed.sinks.jdbc import JdbcSink, StagingMismatch
from tablefeed.sources.generate import Sizes, generate
from tablefeed.specs import TABLES, TableSpec

SIZES = Sizes(supplier=300, customer=150, part=50, orders=100)
ORDERS = TABLES["orders"]
NOW = "2024-01-01 00:00:00.000"

# The same MERGE and text staging, in names and types the other engine has.
MERGING = dataclasses.replace(
    SQL_SERVER,
    quotes=('"', '"'),
    concat="||",
    types=POSTGRESQL.types,
    staging_types={"date": "VARCHAR", "decimal": "VARCHAR"},
    create_if_absent=POSTGRESQL.create_if_absent,
)


class Recorder:
    """A database that another SQL engine plays."""

    def __init__(self):
        self.con = duckdb.connect()
        self.log = []

    def run(self, statements):
        self.log += statements
        con = self.con.cursor()
        con.begin()
        try:
            for text in statements:
                con.execute(text.replace("UNLOGGED ", ""))
        except Exception:
            con.rollback()
            raise
        con.commit()

    def value(self, query):
        return self.con.cursor().execute(query).fetchone()[0]

    def write(self, df, table, batch_rows, connections):
        assert (batch_rows, connections) == (100_000, 16)
        frame = df.toPandas()
        columns = ", ".join(f'"{c}"' for c in frame.columns)
        con = self.con.cursor()
        con.execute(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM frame")

    def read(self, table, column, low, high, connections):
        assert column.strip('"') in ("o_orderkey",) and low <= high and connections == 16
        return SparkSession.active().createDataFrame(
            self.con.cursor().execute(f"SELECT * FROM {table}").fetchdf()
        )

    def tables(self):
        return {r[0] for r in self.con.execute("SELECT table_name FROM duckdb_tables()").fetchall()}

    def rows(self, table):
        return sorted(self.con.execute(f'SELECT * FROM "{table}"').fetchall())


@pytest.fixture(params=[POSTGRESQL, MERGING], ids=["conflict", "merge"])
def sink(spark, request):
    return JdbcSink(spark, Recorder(), request.param)


def test_snapshot(spark, sink):
    loads = generated_loads(spark, "nation,partsupp,orders", SIZES)
    report = run_snapshot(spark, sink, loads, drop=True, strict=True).collect()
    assert {r.table_name: r.loaded_rows for r in report} == {
        "nation": 25, "partsupp": 200, "orders": 100,
    }
    for load in loads:
        assert sink.database.rows(load.spec.name) == sorted(tuple(r) for r in load.rows.collect())
    assert sink.database.tables() == {"nation", "partsupp", "orders"}
    assert any("staging_" in text for text in sink.database.log) == sink.staged
    again = run_snapshot(spark, sink, loads[:1]).first()
    assert again.error and again.loaded_rows is None


@pytest.mark.parametrize("per_set", [1, 3])
def test_changes(spark, sink, per_set):
    run_snapshot(spark, sink, generated_loads(spark, "orders", SIZES), strict=True)
    source = GeneratedChanges(spark, "orders", Sizes(300, 150, 50, 150))
    feed = Feed(ORDERS, source, sink, Pace("orders", 100), lambda n: dt.datetime(2024, 1, 1))
    apply_batches(feed, 0, 3, per_set, run="feed")
    got = {r[0]: r for r in sink.database.rows("orders")}
    want = {r[0]: tuple(r) for r in source.between(0, 150).drop("_ordinal").collect()}
    seen = {r[0] for r in generate(spark, "orders", SIZES).select("o_orderkey").collect()}
    keys = list(want)
    marker = f"{NOW}000+00" if sink.dialect is POSTGRESQL else NOW
    seen |= set(keys[:100])
    for i, key in enumerate(keys):
        old = want[key]
        updated = key in seen
        comment = old[-1][:40] + f" CDC:{marker}" if updated else old[-1]
        assert got[key] == (*old[:-1], comment)
    assert len(got) == 150
    assert {tuple(r) for r in sink.read(ORDERS).collect()} == set(got.values())
    totals = sink.totals(ORDERS)
    assert (totals.sets, totals.operations) == (3 if per_set == 1 else 1, 250)
    assert sink.last_applied(ORDERS) == (2 if per_set == 1 else 0)
    assert sink.database.tables() == {"orders", "applied_change_sets"}
    number = sink.last_applied(ORDERS)
    assert sink.apply(source.at_ticks(0, 1, 100), ORDERS, number, NOW).rows == 0


def test_a_failed_upsert_changes_nothing(spark, sink):
    run_snapshot(spark, sink, generated_loads(spark, "orders", SIZES), strict=True)
    before = sink.database.rows("orders")
    source = GeneratedChanges(spark, "orders", SIZES)
    real = sink.dialect
    sink.dialect = dataclasses.replace(real, upsert=lambda *a: real.upsert(*a) + " nonsense")
    with pytest.raises(duckdb.Error):
        sink.apply(source.at_ticks(0, 1, 100), ORDERS, 0, NOW)
    sink.dialect = real
    assert sink.database.rows("orders") == before and sink.last_applied(ORDERS) == -1
    assert not any(name.startswith("staging_") for name in sink.database.tables())


def test_rows_written_twice_are_noticed(spark, sink):
    staging = sink.create_staging(ORDERS)
    rows = generate(spark, "orders", SIZES)
    write = sink.database.write
    sink.database.write = lambda *a: (write(*a), write(*a))
    with pytest.raises(StagingMismatch, match="holds 200 rows, 100 were sent"):
        sink.stage(rows, ORDERS, staging)


def test_truncate(spark, sink):
    run_snapshot(spark, sink, generated_loads(spark, "nation", SIZES), strict=True)
    sink.truncate_table(TABLES["nation"])
    assert sink.database.rows("nation") == []


SMALL = TableSpec(
    "odd ]\"'",
    T.StructType(
        [
            T.StructField("k", T.LongType(), False),
            T.StructField("m", T.DecimalType(15, 2)),
            T.StructField("d", T.DateType()),
            T.StructField("t", T.StringType()),
        ]
    ),
    ("k",),
    "t",
)


def test_postgresql_text():
    d, name = POSTGRESQL, '"odd ]""\'"'
    assert d.create_table(SMALL) == (
        f'CREATE TABLE IF NOT EXISTS {name} ("k" BIGINT NOT NULL, "m" NUMERIC(15,2), "d" DATE, '
        '"t" TEXT, PRIMARY KEY ("k"))'
    )
    assert d.create_staging(SMALL, "s") == (
        'CREATE UNLOGGED TABLE "s" ("k" BIGINT, "m" NUMERIC(15,2), "d" DATE, "t" TEXT)'
    )
    assert d.upsert_staged(SMALL, "s", "it's") == (
        f'INSERT INTO {name} ("k", "m", "d", "t") SELECT "k", "m", "d", "t" FROM "s" '
        'ON CONFLICT ("k") DO UPDATE SET "m" = EXCLUDED."m", "d" = EXCLUDED."d", '
        "\"t\" = LEFT(EXCLUDED.\"t\", 40) || ' CDC:it''s'"
    )


def test_sql_server_text():
    d, name = SQL_SERVER, "[odd ]]\"']"
    assert d.create_table(SMALL) == (
        "IF OBJECT_ID(N'[odd ]]\"'']', 'U') IS NULL CREATE TABLE " + name
        + " ([k] BIGINT NOT NULL, [m] DECIMAL(15, 2) NULL, [d] DATE NULL, "
        "[t] NVARCHAR(MAX) NULL, PRIMARY KEY ([k]))"
    )
    assert d.create_staging(SMALL, "s") == (
        "CREATE TABLE [s] ([k] BIGINT, [m] NVARCHAR(40), [d] NVARCHAR(10), [t] NVARCHAR(MAX))"
    )
    assert d.upsert_staged(SMALL, "s", NOW) == (
        f"MERGE INTO {name} AS old USING (SELECT [k], CAST([m] AS DECIMAL(15, 2)) AS [m], "
        "CAST([d] AS DATE) AS [d], [t] FROM [s]) AS new ON old.[k] = new.[k] "
        "WHEN MATCHED THEN UPDATE SET [m] = new.[m], [d] = new.[d], "
        f"[t] = LEFT(new.[t], 40) + ' CDC:{NOW}' "
        "WHEN NOT MATCHED THEN INSERT ([k], [m], [d], [t]) "
        "VALUES (new.[k], new.[m], new.[d], new.[t]);"
    )


@pytest.mark.parametrize("dialect", [POSTGRESQL, SQL_SERVER], ids=lambda d: d.name)
@pytest.mark.parametrize(
    "data_type",
    [T.TimestampType(), T.TimestampNTZType(), T.BooleanType(), T.BinaryType(),
     T.ArrayType(T.LongType())],
    ids=lambda t: t.typeName(),
)
def test_unsupported_types(dialect, data_type):
    for staging in (False, True):
        with pytest.raises(UnsupportedType):
            dialect.type_of(data_type, staging)


def test_types_the_tables_do_not_use():
    assert [POSTGRESQL.type_of(t) for t in (T.FloatType(), T.DoubleType())] == [
        "REAL", "DOUBLE PRECISION",
    ]
    assert [SQL_SERVER.type_of(t) for t in (T.FloatType(), T.DoubleType())] == ["REAL", "FLOAT"]
