"""Change files of a folder, applied to a table as they arrive.

Every Parquet file in the folder is one or more change batches. Structured
Streaming keeps in its checkpoint which files each micro-batch has, so a
micro-batch that runs again has the same ones, and the sink applies it once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablefeed.operators.batches import TICK
from tablefeed.plans.cdc import Clock, wall_clock
from tablefeed.sinks.base import Sink
from tablefeed.specs import TableSpec
from tablefeed.streaming.feed import stream_name

FILE, CHANGED = "_file", "_changed"


@dataclass
class FileFeed:
    """The change files of one table. Give a file its final name once it is whole.

    Files are taken in the order they were last changed, at most ``files_per_set``
    at a time. Of several changes of a key in one set the last one wins: by
    ``sequence``, an integer column of the files that the table doesn't have, or
    without it by the order of their files. One batch, that is the rows of equal
    sequence or of one file, must hold a key once.
    """

    spec: TableSpec
    folder: str
    sink: Sink
    sequence: str | None = None
    files_per_set: int = 100
    clock: Clock = wall_clock

    def start(
        self, spark: SparkSession, checkpoint: str, seconds: float | None = None
    ) -> StreamingQuery:
        """Apply what is there and end, or with ``seconds`` look for more that often."""
        schema = T.StructType(list(self.spec.schema.fields))
        if self.sequence:
            schema = schema.add(self.sequence, T.LongType())
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_set)
        rows = files.parquet(self.folder).select(
            "*",
            F.col("_metadata.file_path").alias(FILE),
            F.col("_metadata.file_modification_time").alias(CHANGED),
        )

        def apply(batch: DataFrame, number: int) -> None:
            now_text = self.sink.time_text(self.clock(number))
            feed = stream_name(spark, checkpoint)
            self.sink.apply(self._ticked(batch), self.spec, number, now_text, feed, kept=True)

        writer = rows.writeStream.queryName(f"change files of {self.spec.name}")
        writer = writer.option("checkpointLocation", checkpoint).foreachBatch(apply)
        if seconds is None:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{round(seconds * 1000)} milliseconds").start()

    def _ticked(self, batch: DataFrame) -> DataFrame:
        if self.sequence:
            return batch.select(*self.spec.columns, F.col(self.sequence).alias(TICK))
        # One row per file of the set, of which there are ``files_per_set`` at most.
        taken = batch.select(CHANGED, FILE).distinct().orderBy(CHANGED, FILE).collect()
        order = [(row[FILE], n) for n, row in enumerate(taken)]
        ticks = batch.sparkSession.createDataFrame(order, f"{FILE} string, {TICK} long")
        return batch.join(F.broadcast(ticks), FILE).select(*self.spec.columns, TICK)
