"""Key and null rules that file-based tables do not enforce themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefeed.functions.sizes import row_bytes
from tablefeed.sources.tables import written
from tablefeed.specs import TableSpec


# Most bytes of keys that are sent to every task. A hash table over them takes a few
# times as much.
BROADCAST_KEY_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 32
# With fewer rows to a key, finding the largest values first does not pay.
ROWS_PER_KEY = 4


class KeyViolation(ValueError):
    """A primary key that occurs more than once."""


def duplicate_keys(df: DataFrame, key: Sequence[str], count: str = "row_count") -> DataFrame:
    """Each key that more than one row has, with the number of rows.

    Counted before the shuffle, so a key that many rows share costs one row per task.
    """
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    worst = duplicate_keys(df, key).limit(1).collect()
    if worst:
        raise KeyViolation(f"{what}: key {worst[0].asDict()} is not unique")


def require_absent(df: DataFrame, existing: DataFrame, key: Sequence[str], what: str) -> None:
    """Fail if a row of ``df`` has a key that ``existing`` holds already."""
    clash = df.select(*key).join(existing.select(*key), list(key), "left_semi").limit(1).collect()
    if clash:
        raise KeyViolation(f"{what}: key {clash[0].asDict()} is in the table already")


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row that is largest by ``order``, compared column by column; nulls are least.

    Rows alike in ``order`` are told apart by their other columns, in column order;
    all columns must be of types that can be compared. There are two plans with the
    same result, chosen by the measured number of rows and keys.

    * Few keys with many rows each: the largest values are found by hash tables over
      key and value, and sent to every task; the rows stay where they are.
    * Else every task reduces its rows to one per key before they are shuffled, by
      a sort aggregate. Finding the values first would cost another pass over nearly
      as many keys as there are rows.
    """
    columns = [c for c in order if c not in key]
    columns += [c for c in df.columns if c not in key and c not in columns]
    own = T.StructType([df.schema[c] for c in key])
    told = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.approx_count_distinct(F.struct(*key)).alias("keys"),
        F.max(row_bytes(own)).alias("widest"),
    ).first()
    sent = told["keys"] * ((told["widest"] or 0) + ROW_OVERHEAD_BYTES)
    if told["rows"] >= ROWS_PER_KEY * told["keys"] and sent <= BROADCAST_KEY_BYTES:
        return _latest(df, list(key), columns)
    # The row is its own rank, so each value is carried once.
    best = df.groupBy(*key).agg(F.max(F.struct(*columns)).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _latest(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """By the largest value of the first column, and where rows share it, of the next ones."""
    if not columns:
        return df.distinct()
    first, *others = columns
    names, counted = {c: f"_key_{i}" for i, c in enumerate(key)}, Observation()
    values = df.groupBy(*key, F.col(first).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    # Without any value that is not null, the nulls are the largest.
    alike = F.coalesce(F.max_by("_rows", "_value"), F.sum("_rows"))
    tops = values.groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(
        F.max("_value").alias("_top"), alike.alias("_alike")
    )
    size, tie = row_bytes(tops.schema) + ROW_OVERHEAD_BYTES, F.col("_alike") > 1
    measures = [F.sum(size).alias("all"), F.sum(F.when(tie, size)).alias("tied")]
    tops = written(df.sparkSession, tops.observe(counted, *measures), "latest")

    def at_top(which: DataFrame, size: int | None) -> DataFrame:
        sent = F.broadcast(which) if (size or 0) <= BROADCAST_KEY_BYTES else which.hint("shuffle_hash")
        same = [df[c].eqNullSafe(which[n]) for c, n in names.items()]
        found = df.join(sent, [*same, df[first].eqNullSafe(which["_top"])])
        return found.select(*(df[c] for c in df.columns))

    latest = at_top(tops.where(~tie), counted.get["all"])
    if not counted.get["tied"]:
        return latest
    rest = written(df.sparkSession, at_top(tops.where(tie), counted.get["tied"]), "tied")
    return latest.unionByName(_latest(rest, key, others))


def required_columns(spec: TableSpec) -> list[str]:
    return [f.name for f in spec.schema if not f.nullable or f.name in spec.pk]


def require_values(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The same rows; the job fails on a null in a column that must have a value.

    Checked in the pass that writes the rows, not in one of its own.
    """

    def checked(name: str) -> Column:
        message = F.lit(f"{spec.name}.{name} must not be null")
        value = F.col(name)
        return F.when(value.isNull(), F.raise_error(message)).otherwise(value).alias(name)

    required = set(required_columns(spec))
    return df.select(*[checked(c) if c in required else F.col(c) for c in df.columns])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null, for each column: (column_name, null_rows)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_rows")
