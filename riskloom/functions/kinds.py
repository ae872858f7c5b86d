"""The coarse kind of a column, on which every analysis dispatches."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC, TEMPORAL, BOOL, TEXT, OTHER = "numeric", "temporal", "bool", "text", "other"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return OTHER


def kinds(schema: T.StructType) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in schema}
