"""Column expressions whose Spark built-ins differ from what the analyses need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kinds import OTHER, kind_of


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(quoted(name))


def number(name: str) -> Column:
    """As double; NaN is missing."""
    x = col(name).cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def as_text(field: T.StructField) -> Column:
    """String form of any value; nested and binary values in a form that compares equal when they are."""
    c = col(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def hashable(field: T.StructField) -> Column:
    return as_text(field) if kind_of(field.dataType) == OTHER else col(field.name)


def adjusted_skewness(x: Column) -> Column:
    """Sample skewness G1; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; null if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
