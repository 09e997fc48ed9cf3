"""What a load target can do. Subclass it to load and change tables elsewhere."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablefeed.functions.text import timestamp_text
from tablefeed.specs import TableSpec


@dataclass(frozen=True)
class Applied:
    """What one set of change batches did to a table."""

    rows: int
    inserted: int | None = None
    updated: int | None = None


@dataclass(frozen=True)
class Totals:
    """What the feeds of a table have done to it since it was filled anew.

    ``started`` and ``ended`` are seconds since 1970: when the first set began
    and the last was recorded.
    """

    sets: int = 0
    operations: int = 0
    started: float | None = None
    ended: float | None = None

    def and_then(self, rows: int, began: float, now: float) -> Totals:
        started = began if self.started is None else self.started
        return Totals(self.sets + 1, self.operations + rows, started, now)

    @staticmethod
    def of_all(parts: list[Totals]) -> Totals:
        parts = [p for p in parts if p.sets]
        if not parts:
            return Totals()
        return Totals(
            sum(p.sets for p in parts),
            sum(p.operations for p in parts),
            min(p.started for p in parts),
            max(p.ended for p in parts),
        )

    @property
    def per_second(self) -> float:
        return self.operations / max(self.ended - self.started, 1e-9) if self.sets else 0.0


class Sink:
    """Tables by specification, each with an optional staging table of a run."""

    staged = False

    def create_table(self, spec: TableSpec) -> None:
        """Create the table if it is absent."""
        raise NotImplementedError

    def drop_table(self, spec: TableSpec) -> None:
        """Drop the table if it is present."""
        raise NotImplementedError

    def truncate_table(self, spec: TableSpec) -> None:
        raise NotImplementedError

    def append(
        self, df: DataFrame, spec: TableSpec, keyed: bool = False, stored: bool = False
    ) -> int:
        """Add rows straight to the table and return how many.

        ``stored`` says that they are read from files, at little cost and alike each time.

        ``keyed`` says that keys are known to be distinct and come in order, as generated.
        """
        raise NotImplementedError

    def create_staging(self, spec: TableSpec) -> str:
        """An empty staging table for the columns of ``spec``, without key or null rules."""
        raise NotImplementedError

    def stage(self, df: DataFrame, spec: TableSpec, staging: str) -> int:
        """Add rows to a staging table and return how many."""
        raise NotImplementedError

    def copy_staged(self, spec: TableSpec, staging: str, keyed: bool = False) -> None:
        """Add the staged rows to the table, column by column name."""
        raise NotImplementedError

    def drop_staging(self, staging: str) -> None:
        raise NotImplementedError

    def apply(
        self,
        changes: DataFrame,
        spec: TableSpec,
        number: int,
        now_text: str,
        feed: str = "feed",
        kept: bool = False,
    ) -> Applied:
        """Upsert a set of change batches, whose rows carry their tick.

        ``kept`` says that they are read from files which stay as they are for the
        time, so that reading them again costs little and gives the same rows.

        ``number`` is that of the set in its feed: a set applied before is not
        applied again. Feeds number their sets each for itself, so two feeds of a
        table must not have the same name.
        """
        raise NotImplementedError

    def read(self, spec: TableSpec) -> DataFrame:
        raise NotImplementedError

    def time_text(self, now: dt.datetime) -> str:
        """A time as change markers show it."""
        return timestamp_text(now)

    def totals(self, spec: TableSpec) -> Totals:
        """From the recorded sets, so also after a restart."""
        raise NotImplementedError

    def last_applied(self, spec: TableSpec, feed: str = "feed") -> int:
        """The number of a feed's last set applied since the table was filled anew, or -1."""
        raise NotImplementedError

    def end_feed(self, spec: TableSpec, feed: str) -> None:
        """A feed will not go on: its totals are kept, its name is forgotten."""
