"""Which part of a table's key a row is in.

A table with dense integer keys has ranges of a fixed width over its first key
column. Any other table is cut at stored keys, taken from a sample of the whole
key, so that neither the type of a key nor many rows of one first value matter.
A row's range is then found by binary search.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefeed.functions.draws import range_number
from tablefeed.specs import TableSpec

RANGE = "_key_range"

# Rows of a range take about so many bytes, and a range whose files do is cut.
RANGE_BYTES = 256 * 1024 * 1024
# Keys that are sampled for every range. The sample is sorted by one task: it
# grows with the number of ranges, some thousands of rows to a terabyte.
SAMPLED_KEYS = 20

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
KEY_TYPES = (*INTEGERS, T.StringType, T.DateType, T.DecimalType)


def _key_type(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(c, spec.schema[c].dataType) for c in spec.pk])


@dataclass(frozen=True)
class Layout:
    """``width``, or the lowest keys (as JSON) of all ranges but the first, and the ranges' numbers."""

    width: int | None = None
    starts: tuple[str, ...] = ()
    numbers: tuple[int, ...] = (0,)

    @classmethod
    def read(cls, text: str) -> Layout:
        kept = json.loads(text)
        return cls(kept["width"], tuple(kept["starts"]), tuple(kept["numbers"]))

    def text(self) -> str:
        return json.dumps({"width": self.width, "starts": self.starts, "numbers": self.numbers})

    def check(self, spec: TableSpec) -> None:
        """Refuse keys that can't be cut."""
        first = spec.schema[spec.pk[0]].dataType
        if self.width is not None and not isinstance(first, INTEGERS):
            raise TypeError(f"{spec.name}.{spec.pk[0]} must be an integer for ranges of a width")
        for name in spec.pk:
            if not isinstance(spec.schema[name].dataType, KEY_TYPES):
                raise TypeError(f"{spec.name}.{name} is of a type that keys can't have")

    def range_of(self, spec: TableSpec) -> Column:
        """The number of a row's range."""
        if self.width is not None:
            return range_number(spec.pk[0], self.width)
        if not self.starts:
            return F.lit(self.numbers[0]).cast("long")
        starts = F.from_json(F.lit(f"[{','.join(self.starts)}]"), T.ArrayType(_key_type(spec)))
        numbers = F.from_json(F.lit(json.dumps(self.numbers)), "array<long>")
        key = F.struct(*(F.col(c) for c in spec.pk))

        def halved(span: Column, step: Column) -> Column:
            middle = F.shiftright(span["low"] + span["high"], 1)
            above = F.struct((middle + 1).alias("low"), span["high"].alias("high"))
            below = F.struct(span["low"].alias("low"), middle.alias("high"))
            split = F.when(F.get(starts, middle) <= key, above).otherwise(below)
            return F.when(span["low"] < span["high"], split).otherwise(span)

        steps = F.sequence(F.lit(1), F.lit(len(self.starts).bit_length()))
        whole = F.struct(F.lit(0).alias("low"), F.lit(len(self.starts)).alias("high"))
        return F.aggregate(steps, whole, halved, lambda span: F.get(numbers, span["low"]))

    def cut(self, number: int, starts: Sequence[str]) -> Layout:
        """With the range of a number replaced by ranges that begin at its old start and at ``starts``."""
        at = self.numbers.index(number)
        free = max(self.numbers) + 1
        new = tuple(range(free, free + len(starts) + 1))
        return Layout(
            None,
            (*self.starts[:at], *starts, *self.starts[at:]),
            (*self.numbers[:at], *new, *self.numbers[at + 1 :]),
        )


def sampled_starts(rows: DataFrame, key: Sequence[str], count: int, parts: int) -> list[str]:
    """The lowest keys, as JSON, of all but the first of so many parts of ``count`` rows.

    Parts are of about equal size; there are fewer where there are few rows.
    """
    parts = min(parts, count)
    if parts < 2:
        return []
    share = parts * SAMPLED_KEYS / count
    keys = rows.select(*key)
    if share < 1:
        keys = keys.sample(share, 17)
    sampled = Window.partitionBy()
    ranked = keys.select(
        *key,
        (F.row_number().over(sampled.orderBy(*key)) - 1).alias("_at"),
        F.count(F.lit(1)).over(sampled).alias("_rows"),
    )
    part = F.floor(F.col("_at") * parts / F.col("_rows"))
    before = F.floor((F.col("_at") - 1) * parts / F.col("_rows"))
    first = ranked.where((F.col("_at") > 0) & (part > before))
    told = first.orderBy("_at").select(F.to_json(F.struct(*key)).alias("start")).collect()
    return list(dict.fromkeys(row.start for row in told))
