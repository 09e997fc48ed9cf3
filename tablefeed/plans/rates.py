"""How a target rate becomes batches: the split over tables, batch size and interval."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablefeed.operators.batches import batch_total

# Rows per batch of a snapshot load, and bounds of a change batch.
SNAPSHOT_BATCH = 100_000
SMALLEST_BATCH, LARGEST_BATCH = 100, 1000
BATCHES_PER_SECOND = 10


@dataclass(frozen=True)
class Pace:
    table: str
    rate: int

    @property
    def batch_rows(self) -> int:
        return min(max(self.rate // BATCHES_PER_SECOND, SMALLEST_BATCH), LARGEST_BATCH)

    @property
    def interval_seconds(self) -> float:
        return self.batch_rows / self.rate

    def ticks_by(self, seconds: int) -> int:
        """Batches due in a whole number of seconds from the start."""
        return seconds * self.rate // self.batch_rows


def split_rate(tables: Sequence[str], rate: int) -> list[Pace]:
    """Equal shares of the total rate; what is left over goes to the first table."""
    n = len(tables)
    if n == 0:
        raise ValueError("no tables to change")
    if rate < n:
        raise ValueError(f"a rate of {rate} leaves some of {n} tables without changes")
    share = rate // n
    return [Pace(t, rate - share * (n - 1) if i == 0 else share) for i, t in enumerate(tables)]


def batch_plan(spark: SparkSession, tables: dict[str, DataFrame], rate: int) -> DataFrame:
    """Per table: its rate, batch size and interval, and the batches of one pass over it."""
    rows = []
    for pace in split_rate(list(tables), rate):
        n, size = tables[pace.table].count(), pace.batch_rows
        batches = batch_total(n, size)
        last = n - (batches - 1) * size if n else 0
        rows.append((pace.table, pace.rate, size, pace.interval_seconds, n, batches, last))
    return spark.createDataFrame(
        rows,
        "table_name string, rate long, batch_rows long, interval_seconds double, "
        "source_rows long, batches_per_pass long, last_batch_rows long",
    )
