"""Checked clean-up steps. Each takes a DataFrame and returns a new lazy one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import (
    col,
    comparable,
    holds_map,
    is_floating,
    is_numeric,
    nan_to_null,
    require_columns,
    type_of,
)
from quillgrid.functions.scalars import NUMBER_PATTERN, label_text, measure, value_text

# The type names a cast step takes, and the Spark type each one means.
TYPE_NAMES = {
    "float64": "double", "float32": "float", "float": "double", "Float64": "double", "Float32": "float",
    "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "int": "bigint",
    "Int64": "bigint", "Int32": "int", "Int16": "smallint", "Int8": "tinyint",
    "string": "string", "str": "string", "object": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime64[ns]": "timestamp", "datetime64[us]": "timestamp", "datetime64[ms]": "timestamp",
    "datetime64[s]": "timestamp",
}

# Integer types that cannot hold a missing value.
STRICT_INTEGERS = ("int64", "int32", "int16", "int8", "int")


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    require_columns(df, mapping)
    renamed = [mapping.get(c, c) for c in df.columns]
    if len(set(renamed)) != len(renamed):
        raise ValueError("Two columns would have the same name.")
    return df.select(*[col(c).alias(name) for c, name in zip(df.columns, renamed)])


def _filled(value: Column, dtype: T.DataType, fill) -> Column:
    """Fill with a value; where it does not fit the column's type, the column is widened."""
    if fill is None:
        return value
    if isinstance(fill, bool):
        fits = isinstance(dtype, T.BooleanType)
    elif isinstance(fill, int):
        fits = is_numeric(dtype)
    elif isinstance(fill, float):
        if is_numeric(dtype) and not is_floating(dtype) and not fill.is_integer():
            return F.coalesce(value.cast("double"), F.lit(fill))
        fits = is_numeric(dtype)
    else:
        fits = isinstance(dtype, T.StringType)
    if fits:
        same_type = isinstance(dtype, T.NumericType)
        return F.coalesce(value, F.lit(fill).cast(dtype) if same_type else F.lit(fill))
    return F.coalesce(value_text(value, dtype), F.lit(str(fill)))


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    require_columns(df, values)
    return df.withColumns({c: _filled(col(c), type_of(df, c), v) for c, v in values.items()})


def _cast(value: Column, dtype: T.DataType, name: str) -> Column:
    if name not in TYPE_NAMES:
        raise ValueError(f"Unsupported type: {name}")
    target = TYPE_NAMES[name]
    if target == "string":
        return value_text(value, dtype)
    result = value.cast(target)
    if target in ("double", "float") and isinstance(dtype, T.StringType):
        # Spark's parser also takes a type letter, as in "1d"; that is no number here.
        text = F.trim(value)
        special = F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity")
        bad = ~(text.rlike(NUMBER_PATTERN) | special)
        result = F.when(bad, F.raise_error(F.concat(F.lit("Not a number: "), text))).otherwise(
            result
        )
        result = F.when(~F.isnan(result), result)
    if name in STRICT_INTEGERS:
        missing = F.raise_error(F.lit("Cannot convert missing values to an integer type."))
        return F.when(value.isNull(), missing.cast(target)).otherwise(result)
    return result


def cast_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Strict casts: a cell that cannot be read as the new type fails the job."""
    require_columns(df, mapping)
    return df.withColumns({c: _cast(col(c), type_of(df, c), t) for c, t in mapping.items()})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole rows, with missing values equal to each other.

    Maps, which Spark cannot compare, are compared as sorted lists of their entries.
    """
    clean = nan_to_null(df)
    fields = clean.schema.fields
    if not any(holds_map(f.dataType) for f in fields):
        return clean.dropDuplicates()
    keys = F.struct(*[comparable(col(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)])
    row = F.struct(*[col(f.name) for f in fields])
    return clean.select(keys.alias("key"), row.alias("row")).dropDuplicates(["key"]).select("row.*")


def fill_nulls_lenient(df: DataFrame, column: str | None = None, value: str | None = None):
    """Fill one column, reading the text as a number where it looks like one; 0 by default."""
    column = column or df.columns[0]
    return fill_nulls(df, {column: lenient_value(value or "0")})


def cast_lenient(df: DataFrame, column: str | None = None, target: str = "text") -> DataFrame:
    """Cast one column to `number` or `text`; a cell that is no number becomes NULL."""
    column = column or df.columns[0]
    dtype = type_of(df, column)
    cast = measure(col(column), dtype) if target == "number" else label_text(col(column), dtype)
    return df.withColumn(column, cast)


def lenient_value(text: str):
    """A Python number if the text reads as a finite one, else the text itself."""
    try:
        number = float(text.strip())
    except ValueError:
        return text
    if number in (float("inf"), float("-inf")) or number != number or "_" in text:
        return text
    return int(number) if number.is_integer() else number


# The closed list of operations: how each one reads its parameters.
OPERATIONS = {
    "drop_columns": lambda df, p: drop_columns(df, p.get("columns", [])),
    "rename_columns": lambda df, p: rename_columns(df, p.get("mapping", {})),
    "fill_nulls": lambda df, p: fill_nulls(df, p.get("values", {})),
    "cast_types": lambda df, p: cast_types(df, p.get("mapping", {})),
    "drop_duplicates": lambda df, p: drop_duplicates(df),
}

# Operations after which the number of rows is known without counting.
ROW_PRESERVING = ("drop_columns", "rename_columns", "fill_nulls", "cast_types")


def apply_operation(df: DataFrame, operation: str, parameters: dict | None = None) -> DataFrame:
    if operation not in OPERATIONS:
        raise ValueError(f"No such cleaning step: {operation}")
    result = OPERATIONS[operation](df, parameters or {})
    if not result.columns:
        raise ValueError("No column would be left.")
    return result


def apply_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply steps in order, as one lazy plan."""
    for step in steps:
        df = apply_operation(df, step["operation"], step.get("parameters"))
    return df
