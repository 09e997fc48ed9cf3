"""Change feeds: batches of a source applied to a table, one set of batches at a time."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablefeed.operators.batches import ChangeSource
from tablefeed.plans.rates import Pace
from tablefeed.sinks.base import Applied, Sink, Totals
from tablefeed.specs import TableSpec

ALL_TABLES = "all tables"

Clock = Callable[[int], dt.datetime]


def wall_clock(number: int) -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass
class Feed:
    """The changes of one table: where they come from, where they go, and how fast."""

    spec: TableSpec
    source: ChangeSource
    sink: Sink
    pace: Pace
    clock: Clock = wall_clock

    def apply_ticks(self, first: int, end: int, number: int, run: str = "feed") -> Applied:
        """Apply the batches due at ticks first..end-1 as set ``number`` of a run, unless done before."""
        changes = self.source.at_ticks(first, end, self.pace.batch_rows)
        now_text = self.sink.time_text(self.clock(number))
        return self.sink.apply(changes, self.spec, number, now_text, run, self.source.in_files)


def apply_batches(
    feed: Feed, first: int, end: int, ticks_per_set: int = 1, run: str | None = None
) -> None:
    """Apply the batches of ticks first..end-1 and stop.

    A run that broke off goes on where it stopped if called again with the same
    arguments and ``run``, a name of its own; without one, every call is a new run.
    """
    name = run or f"run-{uuid.uuid4().hex}"
    for number, low in enumerate(range(first, end, ticks_per_set)):
        feed.apply_ticks(low, min(low + ticks_per_set, end), number, name)
    if run is None:
        feed.sink.end_feed(feed.spec, name)


def progress(spark: SparkSession, feeds: Sequence[Feed]) -> DataFrame:
    """Rows applied, in all and per second, for each table and for all of them.

    Read from the sets that the targets have recorded: a restart forgets nothing.
    """
    parts = {f.spec.name: f.sink.totals(f.spec) for f in feeds}
    parts[ALL_TABLES] = Totals.of_all(list(parts.values()))
    rows = [(name, t.sets, t.operations, t.per_second) for name, t in parts.items()]
    return spark.createDataFrame(
        rows, "table_name string, sets long, operations long, operations_per_second double"
    )
