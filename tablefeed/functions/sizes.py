"""How large rows are, measured by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row; nulls count as empty."""

    def width(field: T.StructField) -> Column:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            size = F.size(column) * 16
        else:
            size = F.lit(16)
        return F.coalesce(size, F.lit(0)).cast("long")

    total = F.lit(0).cast("long")
    for field in schema:
        total = total + width(field)
    return total
