"""Whether two cells agree, under one of two profiles.

typed: values are compared as values; both null agree; numbers of any type (and booleans, as 0 and 1) compare with each
other; other types only with their own, so a text never equals a number.
text: values are compared as text, and a null agrees with nothing, not even a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import ConfigError

PROFILES = ("typed", "text")


def kind(dtype: T.DataType) -> str:
    """The class of types with which a type compares."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.MapType):
        raise ConfigError("columns of maps cannot be compared")
    return dtype.simpleString()


def no_nan(column: Column, dtype: T.DataType) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(column), column) if isinstance(dtype, (T.FloatType, T.DoubleType)) else column


def canon(column: Column, dtype: T.DataType) -> Column:
    """A value's text. Whole floating numbers are written out with one decimal, as 10000000.0."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, (column + F.lit(0.0)).cast("decimal(38,1)").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def comparable(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> tuple[Column, Column]:
    """Two numbers in types whose comparison needs no implicit cast."""
    if isinstance(ta, T.BooleanType) and not isinstance(tb, T.BooleanType):
        a, ta = a.cast("int"), T.IntegerType()
    if isinstance(tb, T.BooleanType) and not isinstance(ta, T.BooleanType):
        b, tb = b.cast("int"), T.IntegerType()
    if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (ta, tb)) and ta != tb:
        return a.cast("double"), b.cast("double")
    return a, b


def same(a: Column, b: Column, ta: T.DataType, tb: T.DataType, profile: str) -> Column:
    """Whether two cells are equal; never null."""
    if profile == "text":
        equal = a == b if ta == tb else canon(a, ta) == canon(b, tb)
        return F.coalesce(equal, F.lit(False))
    if kind(ta) == kind(tb) or "null" in (kind(ta), kind(tb)):
        a, b = comparable(a, b, ta, tb) if kind(ta) == kind(tb) == "number" else (a, b)
        return a.eqNullSafe(b)
    return a.isNull() & b.isNull()


def key_pair(a: Column, b: Column, ta: T.DataType, tb: T.DataType, name: str, profile: str) -> tuple[Column, Column]:
    """Key columns in one type; ConfigError where the typed profile has none."""
    if ta == tb:
        return a, b
    if kind(ta) == kind(tb) == "number":
        return comparable(a, b, ta, tb)
    if kind(ta) == kind(tb):
        return a, b
    if profile == "typed":
        raise ConfigError(f"key {name!r} is {ta.simpleString()} in the first table and {tb.simpleString()} in the second")
    return canon(a, ta), canon(b, tb)
