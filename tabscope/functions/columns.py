"""Column type classes and small column expressions shared by all operators.

Type classes follow the reference's rules: numeric = integer, floating and
decimal types (booleans are not numeric); "categorical" = everything that is
not numeric, dates included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
ATOMIC_TYPES = (T.StringType, T.BooleanType, T.BinaryType) + NUMERIC_TYPES + DATETIME_TYPES


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric (strings, booleans and dates)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_typed_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGER_TYPES)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.StringType):
        return "text"
    return "other"


def q(name: str) -> str:
    """Back-quote a column name for use in SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def num(df: DataFrame, name: str) -> Column:
    """Numeric value as DOUBLE with NaN folded into NULL.

    pandas treats NaN as missing; Spark's avg/max/percentile treat it as a
    value, so every numeric operator reads its input through this.
    """
    c = col(name)
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_text(df: DataFrame, name: str) -> Column:
    """String form of a value (the reference compares values via ``str``)."""
    c = col(name)
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        c = F.when(~F.isnan(c), c)
    return c.cast("string")
