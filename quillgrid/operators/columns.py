"""Choosing, truncating and normalising columns for display."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillgrid.functions.columns import col
from quillgrid.functions.scalars import PREVIEW_CELL_CHARS, preview_value

# Fixed value: how many columns a preview shows.
PREVIEW_COLUMNS = 100


def search_columns(df: DataFrame, text: str) -> DataFrame:
    """Keep the columns whose name contains the text, whatever its case."""
    return df.select(*[col(c) for c in df.columns if text.lower() in c.lower()])


def truncate_columns(df: DataFrame, limit: int | None = PREVIEW_COLUMNS) -> tuple[DataFrame, int]:
    """The first `limit` columns (None: all), and how many were hidden."""
    kept = df.columns[:limit]
    return df.select(*[col(c) for c in kept]), len(df.columns) - len(kept)


def preview_cells(df: DataFrame, limit: int | None = PREVIEW_CELL_CHARS) -> DataFrame:
    """Every cell in the form a preview prints."""
    return df.select(
        *[preview_value(col(f.name), f.dataType, limit).alias(f.name) for f in df.schema.fields]
    )
