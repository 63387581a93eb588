"""Text forms of values, one for the engine and its SQL alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_index_string(column: Column, kind: T.DataType) -> Column:
    """How a value is written in the value index: whole numbers without a fraction, arrays joined by commas, timestamps as
    yyyy-MM-dd HH:mm:ss.SSS (values that differ in less are one). Null stays null, and is empty within an array."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("decimal(18,0)").cast("string")).otherwise(column.cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(column, lambda x: F.coalesce(to_index_string(x, kind.elementType), F.lit(""))), ",")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")
    return column.cast("string")
