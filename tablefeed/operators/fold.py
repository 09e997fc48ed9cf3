"""Several change batches as one: the last change of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefeed.functions.sizes import row_bytes
from tablefeed.operators.batches import TICK
from tablefeed.operators.upsert import SHUFFLE, sent_whole
from tablefeed.specs import TableSpec

CHANGED_BEFORE = "_changed_before"
LAST, ROWS, BYTES = "_last", "_rows", "_bytes"


def tick_counts(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Per key: its last tick, whether it has an earlier one, rows, and their bytes.

    Numbers alone, so that tasks count in hash tables before they send anything, and once.
    """
    return changes.groupBy(*spec.pk).agg(
        F.max(TICK).alias(TICK),
        (F.min(TICK) < F.max(TICK)).alias(CHANGED_BEFORE),
        F.count(F.lit(1)).alias(ROWS),
        F.sum(row_bytes(spec.schema)).alias(BYTES),
    )


def last_changes(
    changes: DataFrame, keys: DataFrame, spec: TableSpec, plan: str = SHUFFLE, *more: str
) -> DataFrame:
    """The changes at the last tick of their key, by ``tick_counts``, and columns of the latter."""
    last = keys.select(*spec.pk, F.col(TICK).alias(LAST), CHANGED_BEFORE, *more)
    # A hash table over the keys finds them: neither side is sorted. Ticks are not asked to be
    # equal, so that rows are dealt by the key alone, as the join with the target needs them.
    found = changes.join(sent_whole(last, plan), list(spec.pk)).where(F.col(TICK) >= F.col(LAST))
    return found.select(*spec.columns, CHANGED_BEFORE, *more)


def fold_batches(changes: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per key: its change with the highest tick, and whether it had earlier ones.

    Applying the result equals applying the batches one by one, as a key that
    changed before would have been found by its last batch. Each batch must
    hold a key once (``require_unique`` on the key and the tick). ``changes`` is
    read twice.
    """
    return last_changes(changes, tick_counts(changes, spec), spec)
