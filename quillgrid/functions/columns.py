"""Naming and typing helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers only: booleans are not measures here."""
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def require_columns(df: DataFrame, names) -> None:
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"The table has no column named {', '.join(unknown)}.")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that one rule for missing values holds."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if is_floating(f.dataType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    return isinstance(dtype, T.MapType)


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A value that can be compared and grouped: maps, at any depth, become sorted lists of their
    entries."""
    if not holds_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.struct(
            e["key"].alias("key"), comparable(e["value"], dtype.valueType).alias("value")
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: comparable(e, dtype.elementType))
    fields = [comparable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows in the order given, or all rows where it is None."""
    return df if limit is None else df.limit(limit)
