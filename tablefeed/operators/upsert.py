"""Insert-or-update by primary key, without a table format that has MERGE.

A change row whose key is in the target replaces the whole target row, and its
comment is marked; any other change row is added as it is; target rows with no
change are kept. Nothing is deleted.

There are two plans with the same result.

* broadcast: the keys of the changes, and then the keys found in the target,
  are sent to every task. The target is read where it lies; of its rows only the
  keys found are shuffled.
* shuffle: one full outer join by key, for change sets of any size. Target and
  changes are each shuffled once.

``plan_for`` chooses between them from the measured size of the change set. A
target that repeats keys has to be named as such for the second: a change then
takes the place of all rows of its key, which takes two joins instead of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefeed.functions.text import marked
from tablefeed.operators.keys import BROADCAST_KEY_BYTES, ROW_OVERHEAD_BYTES, require_unique
from tablefeed.specs import TableSpec

BROADCAST, SHUFFLE = "broadcast", "shuffle"

FOUND, BEFORE, EFFECT = "_found", "_before", "_effect"
KEPT, INSERTED, UPDATED = 0, 1, 2


@dataclass(frozen=True)
class ChangeSize:
    """What a change set was measured to hold."""

    rows: int
    key_bytes: int


def size_measures(spec: TableSpec) -> list[Column]:
    """Aggregates that measure a change set; nulls count as empty."""
    width = F.lit(ROW_OVERHEAD_BYTES).cast("long")
    for name in spec.pk:
        if isinstance(spec.schema[name].dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(name), F.lit(0)) + 16
        else:
            width = width + 16
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(width), F.lit(0)).cast("long").alias("key_bytes"),
    ]


def measure_changes(changes: DataFrame, spec: TableSpec) -> ChangeSize:
    """The size of a change set, whose keys must be unique: both from one pass over its keys.

    Counted before the shuffle, so a key that many rows share costs one row per task.
    """
    each = changes.groupBy(*spec.pk).agg(F.count(F.lit(1)).alias("_rows"))
    row = each.agg(*size_measures(spec), F.max("_rows").alias("most")).first()
    if row["most"] is not None and row["most"] > 1:
        require_unique(changes, spec.pk, f"changes of {spec.name}")
    return ChangeSize(row["rows"], row["key_bytes"])


def plan_for(size: ChangeSize, limit: int = BROADCAST_KEY_BYTES) -> str:
    return BROADCAST if size.key_bytes <= limit else SHUFFLE


def _incoming(spec: TableSpec, name: str, value: Column, hit: Column, now_text: str | None):
    """A change row's value: as it is, but the comment of an update is marked."""
    if now_text is not None and name == spec.comment:
        value = F.when(hit, marked(value, now_text)).otherwise(value)
    return value.alias(name)


def upsert(
    target: DataFrame,
    changes: DataFrame,
    spec: TableSpec,
    now_text: str | None = None,
    plan: str = SHUFFLE,
    hit_before: str | None = None,
    effect: str | None = None,
    gather: str | None = None,
    keys: DataFrame | None = None,
    repeats: bool = False,
) -> DataFrame:
    """The target after the changes.

    Keys of the changes must be unique (``keys.require_unique``). ``now_text``
    is the time put into the marker; without it, or without a comment column,
    nothing is marked. ``hit_before`` names a boolean column of ``changes`` that
    is true where an earlier change of the same set had the row's key.
    ``effect`` names a column to add, which says what was done to each row.
    ``gather`` names a column whose values are brought together for writing, in
    the rows that the plan moves anyway: kept rows stay where they are read.
    ``keys`` may give the keys of the changes, where they are cheaper to read by
    themselves. ``repeats`` says that the target may hold a key more than once.
    """
    before = F.col(hit_before) if hit_before else F.lit(False)
    changes = changes.select(*spec.columns, before.alias(BEFORE))
    target = target.select(*spec.columns)
    if plan == SHUFFLE and not repeats:
        result = _gathered(_upsert_full(target, changes, spec, now_text), gather)
    else:
        keys = changes.select(*spec.pk) if keys is None else keys
        result = _upsert_joined(target, changes, keys, spec, now_text, gather, plan)
    return result.withColumnRenamed(EFFECT, effect) if effect else result.drop(EFFECT)


def sent_whole(rows: DataFrame, plan: str) -> DataFrame:
    """The side of a join to make a hash table of: in every task, or in each for its keys."""
    return F.broadcast(rows) if plan == BROADCAST else rows.hint("shuffle_hash")


def _upsert_full(
    target: DataFrame, changes: DataFrame, spec: TableSpec, now_text: str | None
) -> DataFrame:
    """Old and new row of every key side by side. Keys are unique on both sides."""
    there = F.lit(True).alias("_there")
    old = target.select(*spec.pk, F.struct(there, *spec.payload).alias("_old"))
    new = changes.select(*spec.pk, F.struct(there, *spec.payload, BEFORE).alias("_new"))
    both = old.join(new, list(spec.pk), "full")
    changed, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    hit = changed & (known | F.col(f"_new.{BEFORE}"))

    def value(name: str) -> Column:
        if name in spec.pk:
            return F.col(name)
        incoming = _incoming(spec, name, F.col("_new")[name], hit, now_text)
        return F.when(changed, incoming).otherwise(F.col("_old")[name]).alias(name)

    done = F.when(~changed, KEPT).when(known, UPDATED).otherwise(INSERTED).alias(EFFECT)
    return both.select(*map(value, spec.columns), done)


def _gathered(rows: DataFrame, column: str | None) -> DataFrame:
    return rows.hint("rebalance", column) if column else rows


def _upsert_joined(target, changes, keys, spec, now_text, gather, plan) -> DataFrame:
    """Target rows without a change, and the changes."""
    key = list(spec.pk)

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if plan == BROADCAST else rows

    change_keys = sent(keys)
    kept = target.join(change_keys, key, "left_anti")
    # Distinct, so no larger than the change keys that were measured.
    found = target.select(*key).join(change_keys, key, "left_semi").distinct()
    touched = changes.join(sent(found.withColumn(FOUND, F.lit(True))), key, "left")
    touched = touched.withColumn(FOUND, F.coalesce(FOUND, F.lit(False)))
    hit = F.col(FOUND) | F.col(BEFORE)
    rows = [_incoming(spec, c, F.col(c), hit, now_text) for c in spec.columns]
    done = F.when(F.col(FOUND), UPDATED).otherwise(INSERTED).alias(EFFECT)
    kept = kept.select(*spec.columns, F.lit(KEPT).alias(EFFECT))
    return kept.unionByName(_gathered(touched.select(*rows, done), gather))


def upsert_counts(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: how many rows an upsert would insert, update and keep. Only keys move."""
    key = list(spec.pk)
    old = target.select(*key, F.lit(True).alias("_old"))
    new = changes.select(*key, F.lit(True).alias("_new"))
    in_old, in_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return old.join(new, key, "full").agg(
        F.count_if(in_new & ~in_old).alias("inserted_rows"),
        F.count_if(in_new & in_old).alias("updated_rows"),
        F.count_if(in_old & ~in_new).alias("kept_rows"),
    )
