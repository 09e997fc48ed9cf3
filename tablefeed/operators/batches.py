"""Numbered batches over a table, replayed without end.

Rows get dense ordinals in key order; batch ``b`` holds ordinals
``b * size .. (b + 1) * size - 1`` and the last batch of a pass may be short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablefeed import files
from tablefeed.functions.draws import range_number
from tablefeed.functions.sizes import row_bytes
from tablefeed.session import scratch_path
from tablefeed.sources.generate import ORDINAL, Sizes, row_count, rows_between

BATCH, TICK = "batch_no", "tick"
CHUNK, PLACE = "_chunk", "_place"
POSITION_BITS = 33

# A task sorts and writes a chunk of about this size in memory.
CHUNK_BYTES = 256 * 1024 * 1024


class NumberedRows:
    """Rows kept in order in one folder, a sub-folder for each chunk of the order.

    Reading some ordinals opens the chunks that hold them and no others. The
    driver keeps one number per chunk, where it starts.
    """

    def __init__(
        self,
        spark: SparkSession,
        df: DataFrame,
        order: Sequence[str],
        path: str,
        stored: bool = False,
    ) -> None:
        self.spark, self.path, self.columns = spark, path, df.columns
        made, sizes = f"{path}-unsorted", Observation()
        measures = [F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("bytes")]
        if stored:
            kept, size = df, df.agg(*measures).first().asDict()
        else:
            # The source runs once: its rows are measured while they are written, and
            # cut and sorted from these files.
            df.observe(sizes, *measures).write.parquet(made)
            kept, size = spark.read.parquet(made), sizes.get
        chunks = chunk_count(spark, size["rows"], size["bytes"] or 0)
        ranged = kept.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
        position = F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1)
        placed = ranged.withColumns({CHUNK: F.spark_partition_id(), PLACE: position})
        placed.write.partitionBy(CHUNK).parquet(path)
        files.delete(spark, made)

        self.rows = spark.read.schema(placed.schema).parquet(path)
        counts = self.rows.groupBy(CHUNK).count().orderBy(CHUNK).collect()
        self.starts, self.total = [], 0
        for row in counts:
            self.starts.append((row[CHUNK], self.total))
            self.total += row["count"]

    def between(self, low: int, high: int) -> DataFrame:
        """The rows with ordinals low..high-1, with the ordinal."""
        ends = [start for _, start in self.starts[1:]] + [self.total]
        held = [s for s, end in zip(self.starts, ends) if s[1] < high and end > low] or [(0, 0)]
        # One row per chunk: far below any broadcast limit.
        starts = self.spark.createDataFrame(held, f"{CHUNK} int, _start long")
        rows = self.rows.where(F.col(CHUNK).between(held[0][0], held[-1][0]))
        ordinal = (F.col("_start") + F.col(PLACE)).alias(ORDINAL)
        found = rows.join(F.broadcast(starts), CHUNK).select(*self.columns, ordinal)
        return found.where((F.col(ORDINAL) >= low) & (F.col(ORDINAL) < high))

    def drop(self) -> None:
        files.delete(self.spark, self.path)


def chunk_count(spark: SparkSession, rows: int, size: int) -> int:
    """Chunks of ``CHUNK_BYTES`` or less, by the measured size of the rows."""
    # Small tables still use the cores there are.
    by_cores = min(spark.sparkContext.defaultParallelism, rows // 10_000)
    return max(1, -(-size // CHUNK_BYTES), by_cores)


def numbered(
    spark: SparkSession,
    df: DataFrame,
    order: Sequence[str],
    path: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """The rows with ``ORDINAL``, their place in ``order``, from 0.

    ``order`` must tell any two rows apart. The rows are range-partitioned,
    sorted within partitions and written once with their partition and place in
    it, so that counting the partitions and numbering the rows see the same
    ones, also after executors are lost. ``df`` is run once, into files, unless
    ``stored`` says that it reads files itself and costs little.
    """
    kept = NumberedRows(spark, df, order, path or scratch_path(spark, "numbered"), stored)
    return kept.between(0, kept.total)


def batch_number(size: int) -> Column:
    """The batch of a row that has an ordinal."""
    if size < 1:
        raise ValueError("a batch needs at least one row")
    return range_number(ORDINAL, size)


def batch_total(rows: int, size: int) -> int:
    return -(-rows // size)


def replayed(df: DataFrame, batches: int, ticks: int) -> DataFrame:
    """The batches of ``df`` as ticks 0..ticks-1 call for them, starting over at the end.

    A row appears once per pass: at ticks b, b + batches, b + 2 * batches, ...
    """
    if batches < 1:
        raise ValueError("an empty source has no batches to replay")
    due = df.where(F.col(BATCH) < ticks)
    at = F.sequence(F.col(BATCH), F.lit(ticks - 1).cast("long"), F.lit(batches).cast("long"))
    return due.withColumn(TICK, F.explode(at))


class ChangeSource:
    """Rows that can be fetched by ordinal, and the endless batches made from them."""

    total: int
    #: Whether the rows lie in files.
    in_files = False

    def between(self, low: int, high: int) -> DataFrame:
        """The rows with ordinals low..high-1, with the ordinal."""
        raise NotImplementedError

    def batches(self, size: int) -> int:
        """Batches of one pass."""
        if self.total < 1:
            raise ValueError("the change source has no rows")
        return batch_total(self.total, size)

    def at_ticks(self, first: int, end: int, size: int) -> DataFrame:
        """The rows due at ticks first..end-1, with the tick.

        Each tick takes the next batch; after the last, possibly short, one the
        first follows again.
        """
        per_pass = self.batches(size)
        low, last = first % per_pass, (end - 1) % per_pass
        if end - first >= per_pass:
            due = self.between(0, self.total)
        elif low <= last:
            due = self.between(low * size, min((last + 1) * size, self.total))
        else:
            due = self.between(low * size, self.total)
            due = due.unionByName(self.between(0, (last + 1) * size))
        wait = F.pmod(batch_number(size) - first, F.lit(per_pass).cast("long"))
        tick = F.lit(first).cast("long") + wait
        if end - first > per_pass:
            step = F.lit(per_pass).cast("long")
            tick = F.explode(F.sequence(tick, F.lit(end - 1).cast("long"), step))
        return due.withColumn(TICK, tick).drop(ORDINAL)


@dataclass
class GeneratedChanges(ChangeSource):
    """One of the eight tables; any range of it is made from its ids alone."""

    spark: SparkSession
    table: str
    sizes: Sizes

    def __post_init__(self) -> None:
        self.total = row_count(self.spark, self.table, self.sizes)

    def between(self, low: int, high: int) -> DataFrame:
        return rows_between(self.spark, self.table, self.sizes, low, high)


class TableChanges(ChangeSource):
    """A table, numbered once in key order and kept in chunks of that order."""

    in_files = True

    def __init__(
        self, spark: SparkSession, df: DataFrame, order: Sequence[str], stored: bool = False
    ) -> None:
        self.kept = NumberedRows(spark, df, order, scratch_path(spark, "changes"), stored)
        self.total = self.kept.total

    def between(self, low: int, high: int) -> DataFrame:
        return self.kept.between(low, high)

    def close(self) -> None:
        """Delete the kept rows; the source is of no use after that."""
        self.kept.drop()
