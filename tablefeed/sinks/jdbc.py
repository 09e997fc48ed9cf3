"""Tables in a database that every executor can reach over JDBC.

Executors write rows to a table in parallel; what must be all-or-nothing (the
copy from staging, the upsert) is a single transaction that the database runs.
Spark writes each partition in its own transaction, and a task that is run
again may write its rows twice, so staged rows are counted before they are used.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablefeed import files
from tablefeed.functions.text import encode
from tablefeed.operators.batches import TICK
from tablefeed.operators.fold import CHANGED_BEFORE, fold_batches
from tablefeed.operators.keys import require_unique, require_values
from tablefeed.plans.rates import SNAPSHOT_BATCH
from tablefeed.session import scratch_path
from tablefeed.sinks.base import Applied, Sink, Totals
from tablefeed.sinks.dialects import Dialect
from tablefeed.specs import TableSpec

CONNECTIONS = 16
LEDGER = "applied_change_sets"


class StagingMismatch(RuntimeError):
    """A staging table that does not hold exactly the rows sent to it."""


class Database(Protocol):
    def run(self, statements: Sequence[str]) -> None:
        """Execute the statements in one transaction."""

    def value(self, query: str) -> int | None:
        """The number in the only row of a query, or None if it is null."""

    def write(self, df: DataFrame, table: str, batch_rows: int, connections: int) -> None:
        """Append rows to a table."""

    def read(self, table: str, column: str, low: int, high: int, connections: int) -> DataFrame:
        """A table's rows, read in as many ranges of an integer column as there are connections."""


class JdbcDatabase:
    """A connection by URL. Statements run on the driver, rows are written by executors."""

    def __init__(self, spark: SparkSession, url: str, **properties: str) -> None:
        self.spark, self.url, self.properties = spark, url, properties

    def _connect(self):
        jvm = self.spark._jvm
        if driver := self.properties.get("driver"):
            jvm.java.lang.Class.forName(driver)
        settings = jvm.java.util.Properties()
        for key, value in self.properties.items():
            settings.setProperty(key, value)
        return jvm.java.sql.DriverManager.getConnection(self.url, settings)

    def run(self, statements: Sequence[str]) -> None:
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for text in statements:
                statement.execute(text)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def value(self, query: str) -> int | None:
        connection = self._connect()
        try:
            rows = connection.createStatement().executeQuery(query)
            text = rows.getString(1) if rows.next() else None
            return None if text is None else int(text)
        finally:
            connection.close()

    def write(self, df: DataFrame, table: str, batch_rows: int, connections: int) -> None:
        options = {"batchsize": batch_rows, "numPartitions": connections}
        writer = df.write.mode("append").options(**options)
        writer.jdbc(self.url, table, properties=self.properties)


    def read(self, table: str, column: str, low: int, high: int, connections: int) -> DataFrame:
        return self.spark.read.jdbc(
            self.url, table, column, low, high + 1, connections, properties=self.properties
        )


class JdbcSink(Sink):
    def __init__(
        self,
        spark: SparkSession,
        database: Database,
        dialect: Dialect,
        staged: bool | None = None,
        connections: int = CONNECTIONS,
    ) -> None:
        self.spark = spark
        self.database = database
        self.dialect = dialect
        self.staged = dialect.staged if staged is None else staged
        self.connections = connections

    # -- tables ---------------------------------------------------------------

    def create_table(self, spec: TableSpec) -> None:
        self.database.run([self.dialect.create_table(spec)])

    def drop_table(self, spec: TableSpec) -> None:
        self.database.run([self.dialect.drop(spec.name), *self._forget(spec)])

    def truncate_table(self, spec: TableSpec) -> None:
        self.database.run([self.dialect.truncate(spec.name), *self._forget(spec)])

    def _forget(self, spec: TableSpec) -> list[str]:
        """Statements after which no set of any feed counts as applied."""
        there = f"SELECT COUNT(*) FROM information_schema.tables WHERE table_name = '{LEDGER}'"
        if not self.database.value(there):
            return []
        ledger = self.dialect.quote(LEDGER)
        return [f"DELETE FROM {ledger} WHERE table_name = {self._name_text(spec)}"]

    def _write(self, df: DataFrame, table: str) -> int:
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        quoted = self.dialect.quote(table)
        self.database.write(rows, quoted, SNAPSHOT_BATCH, self.connections)
        return seen.get["rows"]

    def append(
        self, df: DataFrame, spec: TableSpec, keyed: bool = False, stored: bool = False
    ) -> int:
        """Keys and nulls are the database's to check; ``keyed`` changes nothing."""
        return self._write(df.select(*spec.columns), spec.name)

    def read(self, spec: TableSpec) -> DataFrame:
        """The first key column must be an integer, by which connections share the rows."""
        table, first = self.dialect.quote(spec.name), self.dialect.quote(spec.pk[0])
        low = self.database.value(f"SELECT MIN({first}) FROM {table}") or 0
        high = self.database.value(f"SELECT MAX({first}) FROM {table}") or 0
        rows = self.database.read(table, first, low, high, self.connections)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema])

    def time_text(self, now: dt.datetime) -> str:
        return self.dialect.time_text(now)

    # -- staging --------------------------------------------------------------

    def create_staging(self, spec: TableSpec) -> str:
        staging = f"staging_{spec.name}_{uuid.uuid4().hex[:12]}"
        self.database.run([self.dialect.drop(staging), self.dialect.create_staging(spec, staging)])
        return staging

    def stage(self, df: DataFrame, spec: TableSpec, staging: str) -> int:
        rows = df.select(*spec.columns)
        if self.dialect.staging_types:
            rows = encode(rows)
        sent = self._write(rows, staging)
        held = self.database.value(f"SELECT COUNT(*) FROM {self.dialect.quote(staging)}")
        if held != sent:
            raise StagingMismatch(f"{staging} holds {held} rows, {sent} were sent")
        return sent

    def copy_staged(self, spec: TableSpec, staging: str, keyed: bool = False) -> None:
        self.database.run([self.dialect.copy_staged(spec, staging)])

    def drop_staging(self, staging: str) -> None:
        self.database.run([self.dialect.drop(staging)])

    # -- changes --------------------------------------------------------------

    def _name_text(self, spec: TableSpec) -> str:
        return "'" + spec.name.replace("'", "''") + "'"

    def _feed_text(self, feed: str) -> str:
        return "'" + feed.replace("'", "''") + "'"

    def last_applied(self, spec: TableSpec, feed: str = "feed") -> int:
        self.database.run([self._ledger_table()])
        ledger = self.dialect.quote(LEDGER)
        found = self.database.value(
            f"SELECT MAX(number) FROM {ledger} WHERE table_name = {self._name_text(spec)} "
            f"AND feed = {self._feed_text(feed)}"
        )
        return -1 if found is None else found

    def totals(self, spec: TableSpec) -> Totals:
        return self._totals(f"table_name = {self._name_text(spec)}")

    def _totals(self, which: str) -> Totals:
        self.database.run([self._ledger_table()])

        def one(measure: str) -> int | None:
            return self.database.value(
                f"SELECT {measure} FROM {self.dialect.quote(LEDGER)} WHERE {which}"
            )

        started, ended = one("MIN(started_ms)"), one("MAX(ended_ms)")
        if started is None:
            return Totals()
        return Totals(one("SUM(sets)"), one("SUM(operations)"), started / 1000, ended / 1000)

    def _ledger_table(self) -> str:
        body = (
            "table_name VARCHAR(200) NOT NULL, feed VARCHAR(200) NOT NULL, number BIGINT NOT NULL, "
            "sets BIGINT NOT NULL, operations BIGINT NOT NULL, "
            "started_ms BIGINT NOT NULL, ended_ms BIGINT NOT NULL, PRIMARY KEY (table_name, feed)"
        )
        return self.dialect.create_if_absent(LEDGER, self.dialect.quote(LEDGER), body)

    def apply(
        self,
        changes: DataFrame,
        spec: TableSpec,
        number: int,
        now_text: str,
        feed: str = "feed",
        kept: bool = False,
    ) -> Applied:
        """Stage the rows, then upsert and record the set in one transaction."""
        if number <= self.last_applied(spec, feed):
            return Applied(0, 0, 0)
        if kept:
            rows = require_values(changes.select(*spec.columns, TICK), spec)
            return self._apply_written(rows, spec, number, now_text, feed)
        path = scratch_path(self.spark, f"changes-{spec.name}")
        require_values(changes.select(*spec.columns, TICK), spec).write.parquet(path)
        try:
            return self._apply_written(self.spark.read.parquet(path), spec, number, now_text, feed)
        finally:
            files.delete(self.spark, path)

    def _apply_written(
        self, changes: DataFrame, spec: TableSpec, number: int, now_text: str, feed: str
    ) -> Applied:
        began = time.time()
        require_unique(changes, [*spec.pk, TICK], f"changes of {spec.name}")
        span = changes.agg(
            F.count(F.lit(1)).alias("rows"), F.min(TICK).alias("first"), F.max(TICK).alias("last")
        ).first()
        sets, made = [changes], []
        if span["first"] != span["last"]:
            # Keys that changed before go in twice, so that the last change finds
            # them and is marked.
            path = scratch_path(self.spark, f"folded-{spec.name}")
            made.append(path)
            fold_batches(changes, spec).write.parquet(path)
            folded = self.spark.read.parquet(path)
            sets = [folded.where(F.col(CHANGED_BEFORE)), folded]
        ledger, name, own = self.dialect.quote(LEDGER), self._name_text(spec), self._feed_text(feed)
        which = f"table_name = {name} AND feed = {own}"
        staging: list[str] = []
        try:
            totals = self._totals(which).and_then(span["rows"], began, time.time())
            told = f"{totals.sets}, {totals.operations}, {round(totals.started * 1000)}, {round(totals.ended * 1000)}"
            for part in sets:
                staging.append(self.create_staging(spec))
                self.stage(part, spec, staging[-1])
            self.database.run(
                [self.dialect.upsert_staged(spec, table, now_text) for table in staging]
                + [
                    f"DELETE FROM {ledger} WHERE {which}",
                    f"INSERT INTO {ledger} "
                    "(table_name, feed, number, sets, operations, started_ms, ended_ms) "
                    f"VALUES ({name}, {own}, {number}, {told})",
                ]
            )
        finally:
            for table in staging:
                self.drop_staging(table)
            for path in made:
                files.delete(self.spark, path)
        return Applied(span["rows"])
