"""Writing CSV, JSON and Parquet directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", quote_all: bool = False):
    """CSV with a header; nested values are written as JSON text."""
    nested = {
        f.name: F.to_json(col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    flat = df.withColumns(nested) if nested else df
    flat.write.mode(mode).csv(path, header=True, quoteAll=quote_all, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "errorifexists"):
    """One record per line, with NULL fields and non-ASCII text kept."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists"):
    df.write.mode(mode).parquet(path)


WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet}


def write_dataset(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists"):
    if fmt not in WRITERS:
        raise ValueError(f"No writer for the format {fmt}")
    WRITERS[fmt](df, path, mode)
