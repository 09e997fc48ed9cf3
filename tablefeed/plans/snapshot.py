"""Snapshot load: drop, create and fill tables, all tables at once, and report on each."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tablefeed.sinks.base import Sink
from tablefeed.sources.generate import Sizes, generate
from tablefeed.specs import TableSpec, select_tables

log = logging.getLogger(__name__)

REPORT = "table_name string, loaded_rows long, error string"
CANCEL_SECONDS = 0.2

# With fewer suppliers the standard formula for partsupp repeats keys at some scale
# factors; such a table fails to load, and another scale factor has to be chosen.
SAFE_SUPPLIERS = 229


class LoadError(RuntimeError):
    """Some tables of a snapshot were not loaded."""


@dataclass(frozen=True)
class Load:
    """What to fill a table with; ``keyed`` and ``stored`` as in ``Sink.append``."""

    spec: TableSpec
    rows: DataFrame
    keyed: bool = False
    stored: bool = False


def generated_loads(spark: SparkSession, tables: str, sizes: Sizes) -> list[Load]:
    """Generated tables; their keys are checked only where the generator can repeat one."""

    def keyed(table: str) -> bool:
        return table != "partsupp" or sizes.supplier >= SAFE_SUPPLIERS

    return [
        Load(spec, generate(spark, spec.name, sizes), keyed(spec.name))
        for spec in select_tables(tables)
    ]


def load_table(sink: Sink, load: Load) -> int:
    """Fill one table, directly or through a staging table, and return the rows added."""
    spec = load.spec
    if not sink.staged:
        return sink.append(load.rows, spec, load.keyed, load.stored)
    staging = sink.create_staging(spec)
    try:
        rows = sink.stage(load.rows, spec, staging)
        sink.copy_staged(spec, staging, load.keyed)
        return rows
    finally:
        sink.drop_staging(staging)


def run_snapshot(
    spark: SparkSession,
    sink: Sink,
    loads: Sequence[Load],
    drop: bool = False,
    create_only: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Load the tables and report (table_name, loaded_rows, error).

    All tables are loaded at once, each in a scheduler pool of its own, so that small
    ones don't wait for large ones where the scheduler is fair. A failure to drop or
    create a table ends the job. A failed load is reported and the other tables carry
    on; with ``strict`` the other loads are cancelled, and then it is raised.
    """
    if drop:
        for load in loads:
            sink.drop_table(load.spec)
    for load in loads:
        sink.create_table(load.spec)
    if create_only:
        return spark.createDataFrame([], REPORT)
    report = _load_all(spark, sink, loads, strict)
    failed = [name for name, _, error in report if error]
    if strict and failed:
        raise LoadError(f"not loaded: {', '.join(failed)}")
    return spark.createDataFrame(report, REPORT)


Outcome = tuple[str, int | None, str | None]


def _load_all(
    spark: SparkSession, sink: Sink, loads: Sequence[Load], strict: bool
) -> list[Outcome]:
    context, tag = spark.sparkContext, f"snapshot-{uuid.uuid4().hex}"
    broken = threading.Event()

    def attempt(load: Load) -> Outcome:
        name = load.spec.name
        if broken.is_set():
            return name, None, "cancelled: another table failed"
        context.setLocalProperty("spark.scheduler.pool", name)
        context.setInterruptOnCancel(True)
        context.addJobTag(tag)
        try:
            rows = load_table(sink, load)
        except Exception as failure:
            if broken.is_set():
                return name, None, "cancelled: another table failed"
            if strict:
                broken.set()
            log.error("%s was not loaded: %s", name, failure)
            return name, None, f"{type(failure).__name__}: {failure}"
        finally:
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)
            context.setLocalProperty("spark.scheduler.pool", None)
        log.info("%s: loaded %d rows", name, rows)
        return name, rows, None

    with ThreadPoolExecutor(max_workers=max(len(loads), 1)) as pool:
        running: list[Future[Outcome]] = [
            pool.submit(inheritable_thread_target(spark)(attempt), load) for load in loads
        ]
        left = set(running)
        while left:
            left = wait(left, timeout=CANCEL_SECONDS).not_done
            if broken.is_set():
                # Again and again: a load may be between two jobs.
                context.cancelJobsWithTag(tag)
        return [outcome.result() for outcome in running]
