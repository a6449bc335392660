"""Scalar functions: rounding, text forms, truncation, escaping and lenient numbers.

All of them are plain Column expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import is_floating, is_temporal

# The widest text cell a preview shows, and the marker put after a cut.
PREVIEW_CELL_CHARS = 512
CUT_MARKER = "..."

# A decimal literal. Java's parser also takes "1d" or "0x1p3", which are no numbers here.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def half_even(value: Column, digits: int = 0) -> Column:
    """Round to `digits` decimals, ties to the even neighbour."""
    return F.bround(value, digits)


def cut_text(value: Column, limit: int | None = PREVIEW_CELL_CHARS) -> Column:
    """Text longer than `limit` (None: no text) becomes its first `limit` characters and a marker."""
    if limit is None:
        return value
    return F.when(
        F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit(CUT_MARKER))
    ).otherwise(value)


def text_prefix(value: Column, limit: int) -> Column:
    return F.substring(value, 1, limit)


def iso_text(value: Column, dtype: T.DataType | None = None) -> Column:
    """ISO-8601 text; the fraction is printed only where there is one."""
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    fraction = F.date_format(value, "SSSSSS")
    seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), fraction))


def byte_placeholder(value: Column) -> Column:
    return F.concat(
        F.lit("<binary value: "), F.octet_length(value).cast("string"), F.lit(" bytes>")
    )


def escape_markup(value: Column) -> Column:
    """Escape the three characters that open markup; the ampersand must go first."""
    escaped = F.replace(value, F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))


def display_number(value: Column) -> Column:
    """Grouped digits with at most two decimals: 1234.5 prints as 1,234.5."""
    text = F.format_number(F.round(value.cast("double"), 2), 2)
    return F.regexp_replace(text, r"\.?0+$", "")


def export_name(name: Column) -> Column:
    """`orders.v1.csv` is exported as `processed-orders.v1.csv`, its folder removed."""
    return F.concat(F.lit("processed-"), F.regexp_extract(name, r"([^/]*)$", 1))


def snake_to_words(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def older_than(moment: Column, cutoff: Column) -> Column:
    """True only for a known moment before the cutoff; an unknown one is not old."""
    return F.coalesce(moment < cutoff, F.lit(False))


def as_number(value: Column) -> Column:
    """Text that reads as a finite number gives that number, everything else NULL."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def measure(value: Column, dtype: T.DataType) -> Column:
    """A lenient numeric reading of a column of any type."""
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    return as_number(value)


def double_text(value: Column) -> Column:
    """Shortest text of a double: 2.0, 10000000.0, 0.0005, 1e+16, 1e-05."""
    value = value.cast("double")
    java = value.cast("string")
    size = F.abs(value)
    whole = F.concat(value.cast("decimal(20,0)").cast("string"), F.lit(".0"))

    def plain(decimal: str) -> Column:
        return F.regexp_replace(java.cast(decimal).cast("string"), r"0+$", "")

    exponent = F.regexp_replace(F.lower(F.regexp_replace(java, r"\.0E", "E")), r"e(\d)", "e+$1")
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(value.isNull() | ~java.contains("E"), java)
        .when((size >= 1e7) & (size < 1e16) & (value == F.floor(value)), whole)
        .when((size >= 1e7) & (size < 1e16), plain("decimal(38,18)"))
        .when((size >= 1e-4) & (size < 1), plain("decimal(38,24)"))
        .otherwise(exponent)
    )


def value_text(value: Column, dtype: T.DataType) -> Column:
    """The text form used for labels, text search and text casts."""
    if is_floating(dtype):
        return double_text(value)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def short_double_text(value: Column) -> Column:
    """Shortest text of a double without a needless fraction: 2, 0.00001, 1e-7, 1e+21."""
    value = value.cast("double")
    java = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(java.cast("decimal(38,24)").cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.lower(F.regexp_replace(java, r"\.0E", "E")), r"e(\d)", "e+$1")
    return (
        F.when((size < 1e21) & (value == F.rint(value)), value.cast("decimal(22,0)").cast("string"))
        .when((size >= 1e-6) & (size < 1), plain)
        .when(java.contains("E") & (size >= 1) & (size < 1e14), plain)
        .otherwise(exponent)
    )


def label_text(value: Column, dtype: T.DataType) -> Column:
    """The text form of lenient casts and labels, in which whole numbers have no fraction."""
    return short_double_text(value) if is_floating(dtype) else value_text(value, dtype)


def preview_value(value: Column, dtype: T.DataType, limit: int | None = PREVIEW_CELL_CHARS) -> Column:
    """One preview cell: bytes as a size, long text cut, times as ISO-8601."""
    if isinstance(dtype, T.BinaryType):
        return byte_placeholder(value)
    if isinstance(dtype, T.StringType):
        return cut_text(value, limit)
    if is_temporal(dtype):
        return iso_text(value, dtype)
    return value
