"""Column kinds: every operator picks its columns by kind, not by exact type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATETIME, BOOLEAN, OTHER = (
    "numeric", "categorical", "datetime", "boolean", "other")


def col(name: str) -> Column:
    """Column by its literal name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """The columns of one kind, in table order."""
    return df.select(*[col(c) for c in columns_of(df, kind)])


def dtype_map(df: DataFrame) -> DataFrame:
    """(position, column, dtype, kind), one row per column."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, kind string")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column: both count as missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, with NaN turned into NULL."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Whole table with NaN replaced by NULL in its floating-point columns."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


def batches(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]
