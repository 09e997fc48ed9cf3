"""Progress that arrives by itself: rows written at an interval while feeds run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.plans.cdc import Feed, progress
from tablefeed.streaming.feed import elapsed

# Fixed value: seconds between two reports.
REPORT_SECONDS = 5.0
SCHEMA = (
    "table_name string, sets long, operations long, operations_per_second double, at timestamp"
)


class ProgressReport:
    """A stream that appends the totals of feeds to a folder of Parquet files.

    For each table, and for all of them, one row every ``seconds``, and one more when
    the report is stopped: the last rows are what the targets have recorded by then.
    The numbers come from the targets, so a report may begin or end at any time, and
    a restart of feeds or report forgets nothing.
    """

    def __init__(
        self,
        spark: SparkSession,
        feeds: Sequence[Feed],
        path: str,
        checkpoint: str,
        seconds: float = REPORT_SECONDS,
    ) -> None:
        self.spark, self.feeds, self.path = spark, feeds, path
        clock = elapsed(spark).writeStream.queryName("progress of feeds")
        clock = clock.option("checkpointLocation", checkpoint)
        self.query = (
            clock.foreachBatch(lambda due, number: self._report())
            .trigger(processingTime=f"{round(seconds * 1000)} milliseconds")
            .start()
        )

    def _report(self) -> None:
        now = F.current_timestamp().alias("at")
        rows = progress(self.spark, self.feeds).select("*", now)
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def stop(self) -> None:
        self.query.stop()
        self._report()
