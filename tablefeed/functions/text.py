"""Change markers, and the text form that rows take in a text-typed staging table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the change marker.
MARKER_KEEP = 40
MARKER_LABEL = " CDC:"


def timestamp_text(now: dt.datetime, fraction_digits: int = 3) -> str:
    """``now`` at fixed width, to milliseconds or (6 digits) microseconds."""
    return now.strftime("%Y-%m-%d %H:%M:%S.%f")[: 20 + fraction_digits]


def zoned_timestamp_text(now: dt.datetime) -> str:
    """``now`` in UTC, which a time without a zone is taken to be in, to microseconds."""
    if now.tzinfo:
        now = now.astimezone(dt.timezone.utc)
    return timestamp_text(now, 6) + "+00"


def marked(comment: Column, now_text: str) -> Column:
    """An updated row's comment: the start of the new one, and when it was applied.

    It is built from the incoming comment, so markers never pile up; a null
    comment stays null.
    """
    return F.concat(F.left(comment, F.lit(MARKER_KEEP)), F.lit(MARKER_LABEL + now_text))


def is_text_encoded(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.DecimalType))


def encode(df: DataFrame) -> DataFrame:
    """Dates and decimals as text, every other column as it is."""

    def one(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            # A cast would give a small value in scientific form in some sessions.
            plain = F.format_number(value, field.dataType.scale)
            value = F.replace(plain, F.lit(","), F.lit(""))
        return value.alias(field.name)

    return df.select(*[one(field) for field in df.schema])


def decode(df: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Staged columns cast to the target's types, in its column order.

    Text that does not parse fails the job, whatever the session's settings, or
    becomes null if ``lenient``.
    """

    def one(field: T.StructField) -> Column:
        value = F.col(field.name)
        cast = value.try_cast(field.dataType)
        if not lenient:
            told = F.concat(F.lit(f"[CAST_INVALID_INPUT] {field.name} does not hold a {field.dataType.simpleString()}: "), value.cast("string"))
            wrong = value.isNotNull() & cast.isNull()
            cast = F.when(wrong, F.raise_error(told).cast(field.dataType)).otherwise(cast)
        return cast.alias(field.name)

    return df.select(*[one(field) for field in schema])


def rejects(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Staged rows with at least one text that does not parse as its target type."""
    bad = F.lit(False)
    for field in schema:
        if is_text_encoded(field.dataType):
            text = F.col(field.name)
            bad = bad | (text.isNotNull() & text.try_cast(field.dataType).isNull())
    return df.where(bad)
