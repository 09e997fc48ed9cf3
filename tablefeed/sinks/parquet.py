"""Tables as Parquet folders, one sub-folder per range of the key.

A set of changes rewrites only the key ranges it touches. Its files count from
the moment that its record is written (``sets``): all of them, once, and never
if it broke off before. Readers see the table as it was when they opened it, and
have the time until the set after the next begins to read it. One writer per
table at a time; feeds of one application take turns.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefeed import files
from tablefeed.functions.sizes import row_bytes
from tablefeed.functions.text import decode, encode
from tablefeed.operators.batches import TICK
from tablefeed.operators.fold import (
    BYTES,
    CHANGED_BEFORE,
    ROWS,
    last_changes,
    tick_counts,
)
from tablefeed.operators.keys import require_absent, require_unique, require_values
from tablefeed.operators.upsert import (
    EFFECT,
    INSERTED,
    SHUFFLE,
    UPDATED,
    ChangeSize,
    plan_for,
    size_measures,
    upsert,
)
from tablefeed.session import scratch_path
from tablefeed.sinks.base import Applied, Sink, Totals
from tablefeed.sinks.ranges import RANGE, RANGE_BYTES, Layout, sampled_starts
from tablefeed.sinks.sets import DELETING, SET, SetLog, State
from tablefeed.sources.generate import Sizes
from tablefeed.specs import TableSpec

# A range is read and rewritten as a whole, so it should hold few rows.
ROWS_PER_RANGE = 500_000
# Changes, and files of the target, that a task joins: it sorts some times as much in memory.
JOIN_BYTES = 64 * 1024 * 1024

_turns: dict[str, threading.RLock] = {}
_turns_guard = threading.Lock()


def range_widths(sizes: Sizes) -> dict[str, int]:
    """Widths for the generated tables of a size."""
    # The highest key, and the rows for each key up to it.
    tables = {
        "supplier": (sizes.supplier, 1),
        "customer": (sizes.customer, 1),
        "part": (sizes.part, 1),
        "partsupp": (sizes.part, 4),
        "orders": (sizes.orders * 4, 1 / 4),
        "lineitem": (sizes.orders * 4, 1),
    }
    widths = {}
    for name, (keys, rows_per_key) in tables.items():
        ranges = math.ceil(keys * rows_per_key / ROWS_PER_RANGE)
        widths[name] = math.ceil(keys / ranges)
    return widths


def text_schema(spec: TableSpec) -> T.StructType:
    """The columns of a staging table: no null rules, dates and decimals as text."""
    as_text = (T.DateType, T.DecimalType)
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, as_text) else f.dataType)
            for f in spec.schema
        ]
    )


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class ParquetSink(Sink):
    """Tables below a folder.

    ``widths`` names the tables whose first key column has dense integers, and how
    many of these make a range. Other tables are cut by their whole key when they
    are first filled, and where they grow, into ranges of ``range_bytes``.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        staged: bool = False,
        widths: dict[str, int] | None = None,
        range_bytes: int = RANGE_BYTES,
    ) -> None:
        self.spark = spark
        self.root = root or scratch_path(spark, "tables")
        self.staged = staged
        self.widths = widths or {}
        self.range_bytes = range_bytes

    # -- layout ---------------------------------------------------------------

    def path(self, spec: TableSpec) -> str:
        return f"{self.root}/{spec.name}"

    def _state_folder(self, spec: TableSpec) -> str:
        return f"{self.root}/_state/{spec.name}"

    def _log(self, spec: TableSpec) -> SetLog:
        return SetLog(self.spark, f"{self._state_folder(spec)}/sets", self.path(spec))

    def _layout_path(self, spec: TableSpec, number: int) -> str:
        return f"{self._state_folder(spec)}/layout-{number}.json"

    def layout(self, spec: TableSpec, state: State | None = None) -> Layout:
        """How the table is cut now."""
        number = (state or self._log(spec).current()).layout
        return Layout.read(files.read_text(self.spark, self._layout_path(spec, number)))

    def _new_layout(self, spec: TableSpec, layout: Layout) -> int:
        """Keep a layout, for the next record to name. Those that no record names stay unused."""
        kept = files.names(self.spark, self._state_folder(spec))
        numbers = [int(n[len("layout-") : -len(".json")]) for n in kept if n.startswith("layout-")]
        number = max(numbers, default=-1) + 1
        files.publish_text(self.spark, self._layout_path(spec, number), layout.text())
        return number

    @contextmanager
    def _turn(self, spec: TableSpec) -> Iterator[None]:
        """Feeds of this application change the table one after the other."""
        with _turns_guard:
            turn = _turns.setdefault(self.path(spec), threading.RLock())
        with turn:
            yield

    @contextmanager
    def _work(self, spec: TableSpec) -> Iterator[str]:
        """A folder for the time of one write."""
        path = f"{self.root}/_work/{spec.name}-{uuid.uuid4().hex}"
        try:
            yield path
        finally:
            files.delete(self.spark, path)

    def _stored_schema(self, spec: TableSpec, *parts: str) -> T.StructType:
        columns = [T.StructField(f.name, f.dataType) for f in spec.schema]
        return T.StructType([*columns, *(T.StructField(c, T.LongType()) for c in parts)])

    def _empty(self, spec: TableSpec) -> DataFrame:
        return self.spark.createDataFrame([], self._stored_schema(spec, RANGE, SET))

    def _rows(self, spec: TableSpec, state: State, ranges: Iterable[int] | None = None) -> DataFrame:
        """The rows that count, of all ranges or some; no folder of another range is opened."""
        base = self.path(spec)
        paths = [base]
        if ranges is not None:
            wanted = {f"{RANGE}={number}" for number in ranges}
            paths = [f"{base}/{name}" for name in files.names(self.spark, base) if name in wanted]
            if not paths:
                return self._empty(spec).drop(SET)
        reader = self.spark.read.schema(self._stored_schema(spec, RANGE, SET))
        return reader.option("basePath", base).parquet(*paths).where(state.counts()).drop(SET)

    def read(self, spec: TableSpec) -> DataFrame:
        """The table as it is now. The rows can be read until the set after the next one begins."""
        return self._rows(spec, self._log(spec).current()).select(*spec.columns)

    # -- tables ---------------------------------------------------------------

    def create_table(self, spec: TableSpec) -> None:
        if self._log(spec).current().revision < 0:
            self._create(spec, self.widths.get(spec.name))

    def _create(self, spec: TableSpec, width: int | None) -> None:
        layout = Layout(width)
        layout.check(spec)
        self._empty(spec).write.mode("ignore").partitionBy(RANGE, SET).parquet(self.path(spec))
        self._log(spec).put(State(layout=self._new_layout(spec, layout)))

    def register(self, spec: TableSpec, name: str) -> None:
        """Make the table known to the session catalog, with its key as a property.

        ``name`` may have a database in front. The catalog keeps a list of the
        folders, so call this again after the table has changed.
        """
        quoted = ".".join(quote(part) for part in name.split("."))
        columns = ", ".join(
            f"{quote(f.name)} {f.dataType.simpleString()}"
            for f in self._stored_schema(spec, RANGE, SET)
        )
        properties = {"primary_key": ", ".join(spec.pk), "comment_column": spec.comment or ""}
        listed = ", ".join(f"'{key}' = {text(value)}" for key, value in properties.items())
        with self._turn(spec):
            # Only rows that count are left, so the catalog needs no condition.
            self._log(spec).begin()
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {quoted} ({columns}) USING parquet PARTITIONED BY "
                f"({RANGE}, {SET}) LOCATION {text(self.path(spec))} TBLPROPERTIES ({listed})"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {quoted} SYNC PARTITIONS")

    def drop_table(self, spec: TableSpec) -> None:
        with self._turn(spec):
            files.delete(self.spark, self._state_folder(spec))
            files.delete(self.spark, self.path(spec))

    def truncate_table(self, spec: TableSpec) -> None:
        """Empty the table; no set of any feed counts as applied any more."""
        with self._turn(spec):
            width = self.layout(spec).width
            self.drop_table(spec)
            self._create(spec, width)

    def append(
        self, df: DataFrame, spec: TableSpec, keyed: bool = False, stored: bool = False
    ) -> int:
        df = df.select(*spec.columns)
        if stored or (keyed and self.layout(spec).width is not None):
            return self._append(df, spec, keyed)
        with self._work(spec) as path:
            # The rows may come from anywhere: they are made once.
            require_values(df, spec).write.parquet(path)
            return self._append(self.spark.read.parquet(path), spec, keyed)

    def _append(self, df: DataFrame, spec: TableSpec, keyed: bool) -> int:
        """Add rows, which are read several times unless they are ``keyed`` and new."""
        with self._turn(spec):
            state, number = self._log(spec).begin()
            empty = self._rows(spec, state).isEmpty()
            if not keyed:
                require_unique(df, spec.pk, spec.name)
            layout = self.layout(spec, state)
            if empty and layout.width is None:
                layout = self._first_layout(df, spec)
                state = replace(state, layout=self._new_layout(spec, layout))
            ranged = layout.range_of(spec)
            if not empty:
                touched = self._ranges(df.select(ranged.alias(RANGE)))
                self._log(spec).touches(number, touched)
                require_absent(df, self._rows(spec, state, touched), spec.pk, spec.name)
            seen = Observation()
            rows = require_values(df, spec).withColumn(RANGE, ranged)
            if not keyed:
                # Few files per range, and a range with very many rows is split over tasks.
                rows = rows.hint("rebalance", RANGE)
            # Counted after the shuffle: a task before it may run, and count, twice.
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
            self._write(rows, spec, number)
            count = seen.get["rows"]
            self._log(spec).commit(state, number, [])
            return count

    def _write(self, rows: DataFrame, spec: TableSpec, number: int) -> None:
        placed = rows.withColumn(SET, F.lit(number).cast("long"))
        placed.write.mode("append").partitionBy(RANGE, SET).parquet(self.path(spec))

    def _first_layout(self, df: DataFrame, spec: TableSpec) -> Layout:
        size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("bytes")).first()
        parts = -(-(size["bytes"] or 0) // self.range_bytes)
        starts = sampled_starts(df, spec.pk, size["rows"], parts)
        return Layout(None, tuple(starts), tuple(range(len(starts) + 1)))

    # -- staging --------------------------------------------------------------

    def create_staging(self, spec: TableSpec) -> str:
        return scratch_path(self.spark, f"staging-{spec.name}")

    def stage(self, df: DataFrame, spec: TableSpec, staging: str) -> int:
        seen = Observation()
        rows = df.select(*spec.columns)
        rows = encode(rows) if self.staged else rows
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("append").parquet(staging)
        return seen.get["rows"]

    def staged_rows(self, spec: TableSpec, staging: str) -> DataFrame:
        schema = text_schema(spec) if self.staged else T.StructType(spec.schema.fields)
        return decode(self.spark.read.schema(schema).parquet(staging), spec.schema)

    def copy_staged(self, spec: TableSpec, staging: str, keyed: bool = False) -> None:
        self._append(self.staged_rows(spec, staging).select(*spec.columns), spec, keyed)

    def drop_staging(self, staging: str) -> None:
        files.delete(self.spark, staging)

    # -- changes --------------------------------------------------------------

    def last_applied(self, spec: TableSpec, feed: str = "feed") -> int:
        return self._log(spec).current().last(feed)

    def totals(self, spec: TableSpec) -> Totals:
        return self._log(spec).current().totals()

    def end_feed(self, spec: TableSpec, feed: str) -> None:
        with self._turn(spec):
            state = self._log(spec).current()
            if feed in state.feeds:
                self._log(spec).put(state.without_feed(feed))

    def apply(
        self,
        changes: DataFrame,
        spec: TableSpec,
        number: int,
        now_text: str,
        feed: str = "feed",
        kept: bool = False,
    ) -> Applied:
        with self._turn(spec), self._work(spec) as work:
            state = self._log(spec).current()
            if number <= state.last(feed):
                return Applied(0, 0, 0)
            began = time.time()
            state, set_number = self._log(spec).begin()
            rows = require_values(changes.select(*spec.columns, TICK), spec)
            if not kept:
                # They may come from anywhere: they are made once.
                rows.write.parquet(f"{work}/changes")
                rows = self.spark.read.parquet(f"{work}/changes")
            effect, touched, layout = self._write_set(rows, spec, state, set_number, now_text, work)
            totals = state.feed_totals(feed).and_then(effect.rows, began, time.time())
            state = replace(state.with_feed(feed, number, totals), layout=layout)
            self._log(spec).commit(state, set_number, touched)
            return effect

    def _write_set(
        self, changes: DataFrame, spec: TableSpec, state: State, number: int, now_text: str, work: str
    ) -> tuple[Applied, set[int], int]:
        """Write the new content of every range the changes touch; also these, and the layout."""
        # One pass over the changes says how many and how large they are, whether any key
        # comes twice, which change of each is the last, and their ranges.
        layout, measured = self.layout(spec, state), Observation()
        keys = tick_counts(changes, spec).withColumn(RANGE, layout.range_of(spec))
        measures = [
            *size_measures(spec),
            F.sum(ROWS).alias("changes"),
            F.sum(BYTES).alias("bytes"),
            F.collect_set(RANGE).alias("ranges"),
        ]
        # Observed after the shuffle: a task before it may run, and count, twice.
        keys.observe(measured, *measures).write.parquet(f"{work}/keys")
        got = measured.get
        if got["rows"] == 0:
            return Applied(0, 0, 0), set(), state.layout
        once = got["changes"] == got["rows"]
        if not once:
            require_unique(changes, [*spec.pk, TICK], f"changes of {spec.name}")
        keys, touched = self.spark.read.parquet(f"{work}/keys"), set(got["ranges"])
        self._log(spec).touches(number, touched)

        plan = plan_for(ChangeSize(got["rows"], got["key_bytes"]))
        if plan == SHUFFLE:
            changes = self._dealt(changes, spec, got["bytes"] + sum(self._held(spec, touched).values()))
        if once:
            # No key comes twice: all changes are the last.
            last = changes.withColumn(RANGE, layout.range_of(spec))
        else:
            last = last_changes(changes, keys, spec, plan, RANGE)
        target = self._rows(spec, state, touched)
        stored = replace(spec, schema=self._stored_schema(spec, RANGE))
        grown, named = self._cut_grown(spec, layout, target, keys, got["bytes"] / got["changes"]), state.layout
        if grown != layout:
            named = self._new_layout(spec, grown)
            last = last.withColumn(RANGE, grown.range_of(spec))
            target = target.withColumn(RANGE, grown.range_of(spec))
            new = set(grown.numbers) - set(layout.numbers)
            self._log(spec).touches(number, touched | new)
        before = None if once else CHANGED_BEFORE
        result = upsert(
            target, last, stored, now_text, plan, before, EFFECT, RANGE, keys.select(*spec.pk)
        )
        counts = Observation()
        result = result.observe(
            counts,
            F.count_if(F.col(EFFECT) == INSERTED).alias("inserted"),
            F.count_if(F.col(EFFECT) == UPDATED).alias("updated"),
        )
        self._write(result.drop(EFFECT), spec, number)
        effect = Applied(got["changes"], counts.get["inserted"], counts.get["updated"])
        return effect, touched, named

    def _held(self, spec: TableSpec, ranges: Iterable[int]) -> dict[str, int]:
        """Bytes of files in the folders of those ranges that have one."""
        base = self.path(spec)
        present = set(files.names(self.spark, base)) & {f"{RANGE}={n}" for n in ranges}
        with ThreadPoolExecutor(DELETING) as pool:
            return dict(zip(present, pool.map(lambda n: files.size(self.spark, f"{base}/{n}"), present)))

    def _dealt(self, changes: DataFrame, spec: TableSpec, size: int) -> DataFrame:
        """The changes dealt by key to more tasks than usual where the rows to be joined need it."""
        parts = math.ceil(size / JOIN_BYTES)
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return changes.repartition(parts, *spec.pk) if parts > usual else changes

    def _cut_grown(
        self, spec: TableSpec, layout: Layout, target: DataFrame, keys: DataFrame, row: float
    ) -> Layout:
        """The layout with those ranges cut that hold too much, or would with all keys of the changes.

        ``row`` is the mean size of the changes. A range is weighed by its files and by
        its changes, as if all were new: one that is cut early is no harm.
        """
        if layout.width is not None:
            return layout
        added = {r[RANGE]: r["count"] for r in keys.groupBy(RANGE).count().collect()}
        held = self._held(spec, added)
        weights = {n: held.get(f"{RANGE}={n}", 0) + count * row for n, count in added.items()}
        for number in sorted(n for n, weight in weights.items() if weight >= 2 * self.range_bytes):
            own = F.col(RANGE) == number
            every = target.where(own).select(*spec.pk).unionByName(keys.where(own).select(*spec.pk))
            parts = int(weights[number] // self.range_bytes)
            starts = sampled_starts(every, spec.pk, every.count(), parts)
            layout = layout.cut(number, starts) if starts else layout
        return layout

    def _ranges(self, rows: DataFrame) -> set[int]:
        """The key ranges of some rows: no more than there are folders to be listed or made."""
        return {row[RANGE] for row in rows.select(RANGE).distinct().collect()}
