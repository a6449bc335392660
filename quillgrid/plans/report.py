"""The tables of a data-quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.columns import first_rows
from quillgrid.functions.scalars import double_text
from quillgrid.operators.columns import truncate_columns
from quillgrid.plans.profile import column_profile, suggestions_for, summary

# How many columns and recommendations a report prints.
REPORT_COLUMNS = 25
REPORT_SUGGESTIONS = 50


def executive_summary(df: DataFrame) -> DataFrame:
    """`position, metric, value` rows of the summary; `df` is the profiled table."""
    entries = [
        ("Rows", F.col("rows").cast("string")),
        ("Columns", F.col("columns").cast("string")),
        ("Duplicates", F.col("duplicate_rows").cast("string")),
        ("Missing data", F.concat(double_text(F.col("missing_percentage")), F.lit("%"))),
    ]
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
        for i, (name, value) in enumerate(entries)
    ]
    return summary(df).select(F.inline(F.array(*rows)))


def column_quality(
    df: DataFrame, exact: bool = True, limit: int | None = REPORT_COLUMNS
) -> DataFrame:
    """The first columns with type, missing share, distinct values and outliers.

    Only those columns are profiled; None profiles all.
    """
    shown = truncate_columns(df, limit)[0]
    return column_profile(shown, exact).select(
        "position",
        "column",
        "type",
        "missing_percentage",
        "unique_count",
        F.coalesce("outlier_count", F.lit(0)).alias("outliers"),
    )


def recommendations(df: DataFrame, limit: int | None = REPORT_SUGGESTIONS) -> DataFrame:
    """The first suggestions, numbered; None prints all."""
    first = first_rows(suggestions_for(df).orderBy("position"), limit)
    return first.select("position", F.concat(F.lit("- "), F.col("suggestion")).alias("line"))
