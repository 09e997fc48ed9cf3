"""Change feeds as Structured Streaming queries, one per table.

The stream is a clock: its rows are ticks, or seconds that ticks are due at, and
a tick stands for one batch of the change source. Which rows a tick stands for depends on nothing but
its number, so a micro-batch that runs again after a failure gets the same rows,
and the sink applies each micro-batch once.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablefeed import files
from tablefeed.plans.cdc import Feed

# A micro-batch starts after this time, unless told how many batches to take: the
# fixed cost of a micro-batch is a few seconds, whatever it holds.
SECONDS_PER_SET = 10.0


def ticks(spark: SparkSession, per_trigger: int) -> DataFrame:
    """A stream of tick numbers, ``per_trigger`` of them in each micro-batch."""
    clock = spark.readStream.format("rate-micro-batch")
    return clock.option("rowsPerBatch", per_trigger).option("numPartitions", 1).load()


def elapsed(spark: SparkSession) -> DataFrame:
    """A stream of the seconds since it was first started; a micro-batch holds all new ones.

    Which seconds a micro-batch holds is in its checkpoint, so a retry sees the
    same, and time that a slow set or a stop took is in the next one.
    """
    clock = spark.readStream.format("rate")
    return clock.option("rowsPerSecond", 1).option("numPartitions", 1).load()


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """From the stream's id, which lives in its checkpoint: with a new one, sets count anew."""
    kept = files.read_text(spark, f"{checkpoint}/metadata")
    return f"stream-{json.loads(kept)['id']}"


class FeedFinished(Exception):
    """Ends a stream that is past its last tick."""


class RunningFeed:
    """A started feed. ``until`` is the tick to stop before, or None to go on for ever.

    A micro-batch takes ``ticks_per_set`` ticks, or by default those that are due
    by the time that has passed, so that a feed which fell behind makes up for it.
    A stopped feed goes on where it stopped if it is started again with the same
    checkpoint, provided that ``until`` was a multiple of ``ticks_per_set``.
    """

    def __init__(
        self,
        spark: SparkSession,
        feed: Feed,
        checkpoint: str,
        ticks_per_set: int | None = None,
        until: int | None = None,
        seconds: float | None = None,
    ) -> None:
        self.timed = ticks_per_set is None
        self.feed = feed
        self.until = until
        self.finished = threading.Event()
        self.spark, self.checkpoint = spark, checkpoint
        if seconds is None and self.timed:
            seconds = SECONDS_PER_SET
        elif seconds is None:
            seconds = feed.pace.interval_seconds * ticks_per_set
        due = elapsed(spark) if self.timed else ticks(spark, ticks_per_set)
        writer = due.writeStream.queryName(f"changes of {feed.spec.name}")
        writer = writer.option("checkpointLocation", checkpoint).foreachBatch(self._apply)
        self.query: StreamingQuery = writer.trigger(
            processingTime=f"{round(seconds * 1000)} milliseconds"
        ).start()

    def _apply(self, due: DataFrame, number: int) -> None:
        span = due.agg(F.min("value").alias("first"), F.max("value").alias("last")).first()
        if span["first"] is None:
            return
        first, end = span["first"], span["last"] + 1
        if self.timed:
            first, end = self.feed.pace.ticks_by(first), self.feed.pace.ticks_by(end)
            if first == end:
                return
        if self.until is None or end < self.until:
            self.feed.apply_ticks(first, end, number, self._run())
            return
        if first < self.until:
            self.feed.apply_ticks(first, self.until, number, self._run())
            self.finished.set()
            return
        # Past the last tick: must not count as done, or a later start would skip it.
        self.finished.set()
        raise FeedFinished(f"the changes of {self.feed.spec.name} end at tick {self.until}")

    def _run(self) -> str:
        return stream_name(self.spark, self.checkpoint)

    def wait(self) -> None:
        """Return when the feed has reached its last tick; raise if it failed."""
        while not self.finished.wait(timeout=0.2):
            if not self.query.isActive:
                self.query.awaitTermination()
                raise RuntimeError(f"the changes of {self.feed.spec.name} were stopped")
        self.stop()

    def stop(self) -> None:
        """End the feed now; a set that is being applied is left to the next start."""
        self.query.stop()


def wait_all(feeds: Sequence[RunningFeed]) -> None:
    """Return when all feeds have reached their last tick. If one fails, all end."""
    try:
        for feed in feeds:
            while not feed.finished.wait(timeout=0.2):
                for other in feeds:
                    if not other.finished.is_set() and not other.query.isActive:
                        other.wait()
    finally:
        for feed in feeds:
            feed.stop()


def start_feeds(
    spark: SparkSession,
    feeds: Sequence[Feed],
    checkpoints: str,
    ticks_per_set: int | None = None,
    until: int | None = None,
    seconds: float | None = None,
) -> list[RunningFeed]:
    """Start a feed for each table; if one can't start, none goes on."""
    started: list[RunningFeed] = []
    try:
        for feed in feeds:
            at = f"{checkpoints}/{feed.spec.name}"
            started.append(RunningFeed(spark, feed, at, ticks_per_set, until, seconds))
    except BaseException:
        for running in started:
            running.stop()
        raise
    return started
