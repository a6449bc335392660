"""Previews, versioned snapshots, lineage rows and undo.

A version is an immutable Parquet directory. Which version is active is never stored: it
follows from the lineage rows alone. `versions.py` has the commit log for several writers.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.columns import col, first_rows
from quillgrid.operators.cleaning import ROW_PRESERVING, apply_operation
from quillgrid.operators.columns import PREVIEW_COLUMNS, preview_cells, truncate_columns
from quillgrid.operators.ranking import latest_per_key
from quillgrid.operators.rules import check_structure
from quillgrid.plans import versions
from quillgrid.sources.writers import write_dataset

# Fixed value: how many rows a preview of a step shows.
PREVIEW_ROWS = 20

STEP_SCHEMA = (
    "step int, operation string, parameters string, expected_version int,"
    " before_columns int, after_columns int, before_at int, after_at int"
)


def _counts(df: DataFrame, side: str) -> DataFrame:
    present = sum((F.count(col(c)) for c in df.columns), F.lit(0))
    rows = F.count(F.lit(1))
    width = len(df.columns)
    return df.agg(rows.alias("rows"), (rows * width - present).alias("missing_cells")).select(
        F.lit(side).alias("side"),
        "rows",
        F.lit(width).cast("bigint").alias("columns"),
        "missing_cells",
    )


def preview_counts(df: DataFrame, operation: str, parameters: dict | None = None) -> DataFrame:
    """`side, rows, columns, missing_cells` before and after a step."""
    after = check_structure(apply_operation(df, operation, parameters))
    return _counts(df, "before").unionByName(_counts(after, "after"))


def preview_sample(
    df: DataFrame, operation: str, parameters: dict | None = None, order: list[Column] | None = None,
    rows: int | None = PREVIEW_ROWS, columns: int | None = PREVIEW_COLUMNS,
) -> DataFrame:
    """The first rows after a step, in display form; `order` gives the row order.

    None for `rows` or `columns` shows all; see preview_hidden for what is left out.
    """
    after = check_structure(apply_operation(df, operation, parameters))
    first = first_rows(after.orderBy(*order) if order else after, rows)
    return preview_cells(truncate_columns(first, columns)[0])


def preview_hidden(
    df: DataFrame, operation: str, parameters: dict | None = None,
    rows: int | None = PREVIEW_ROWS, columns: int | None = PREVIEW_COLUMNS,
) -> DataFrame:
    """One row `columns_truncated, rows_hidden`: what a preview of the step does not show."""
    after = check_structure(apply_operation(df, operation, parameters))
    hidden = truncate_columns(after, columns)[1]
    left = F.lit(0).cast("bigint") if rows is None else F.greatest(F.count(F.lit(1)) - rows, F.lit(0))
    return after.agg(F.lit(hidden).alias("columns_truncated"), left.alias("rows_hidden"))


def _step_row(before: DataFrame, after: DataFrame, step: dict, number: int, version: int) -> tuple:
    return (
        number,
        step["operation"],
        json.dumps(step.get("parameters") or {}, sort_keys=True),
        version,
        len(before.columns),
        len(after.columns),
    )


def _lineage(steps: list[tuple], tables: list[DataFrame]) -> DataFrame:
    """Lineage rows; the last two entries of a step name the tables before and after it."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("rows")).withColumn("at", F.lit(i))
            for i, df in enumerate(tables)
        ],
    )
    listed = tables[0].sparkSession.createDataFrame(steps, STEP_SCHEMA)
    before = counts.select(F.col("at").alias("before_at"), F.col("rows").alias("before_rows"))
    after = counts.select(F.col("at").alias("after_at"), F.col("rows").alias("after_rows"))
    return listed.join(before, "before_at").join(after, "after_at").select(
        "step", "operation", "parameters", "expected_version", "before_rows", "after_rows",
        "before_columns", "after_columns", F.lit("completed").alias("status"),
    )


def _stepped(df: DataFrame, step: dict) -> DataFrame:
    return check_structure(apply_operation(df, step["operation"], step.get("parameters")))


def apply_with_lineage(
    df: DataFrame, steps: list[dict], start_version: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The result of all steps and one lineage row per step, both lazy.

    Rows are counted at the start and after steps that can change their number, not after
    every step.
    """
    tables, rows = [df], []
    for number, step in enumerate(steps):
        before, at = df, len(tables) - 1
        df = _stepped(before, step)
        if step["operation"] not in ROW_PRESERVING:
            tables.append(df)
        row = _step_row(before, df, step, number, start_version + number)
        rows.append((*row, at, len(tables) - 1))
    return df, _lineage(rows, tables)


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version}"


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a version to its own new directory; an existing one is never touched."""
    if versions.path_of(df.sparkSession, root, version) is not None:
        raise ValueError(f"Version {version} already exists.")
    path = version_path(root, version)
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """A version by its number; in a dataset with a commit log the newest one of that number."""
    return spark.read.parquet(versions.path_of(spark, root, version) or version_path(root, version))


def apply_and_write(
    df: DataFrame, steps: list[dict], root: str, start_version: int = 1
) -> DataFrame:
    """Write the table and the result of every step as versions; return the lineage rows.

    The first call makes the dataset. After that `versions.apply_steps` goes on with it, also after
    an undo. Each step reads the version before it, so nothing is computed twice, and rows are
    counted while they are written.
    """
    spark = df.sparkSession
    first = versions.create(df, root, version=start_version)
    versions.apply_steps(spark, root, steps)
    return versions.lineage(spark, root).select(
        (F.col("id") - first.last - 1).cast("int").alias("step"), "operation", "parameters",
        "expected_version", "before_rows", "after_rows", "before_columns", "after_columns", "status",
    )


def history(lineage: DataFrame, moment: str = "created_at", key: str = "id") -> DataFrame:
    """Lineage rows, newest first, with the number of rows each step removed."""
    delta = F.col("before_rows") - F.col("after_rows")
    return lineage.withColumn("row_delta", delta).orderBy(col(moment).desc(), col(key).desc())


def active_versions(lineage: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """`dataset, active_version`: one more than the newest completed change, else 1."""
    completed = F.when(F.col("status") == "completed", F.col("expected_version") + 1)
    return lineage.groupBy(col(dataset)).agg(
        F.coalesce(F.max(completed), F.lit(1)).alias("active_version")
    )


def undo_candidates(
    lineage: DataFrame, dataset: str = "dataset_id", user: str = "user_id"
) -> DataFrame:
    """Per dataset and user the newest change that could be undone, and whether it may be.

    It may be only if it produced the active version.
    """
    open_changes = lineage.filter((F.col("status") == "completed") & F.col("undone_at").isNull())
    slim = open_changes.select(col(dataset), col(user), "created_at", "id", "expected_version")
    newest = latest_per_key(slim, [dataset, user], ["created_at", "id"])
    joined = newest.join(active_versions(lineage, dataset), dataset)
    return joined.withColumn(
        "allowed", F.col("active_version") == F.col("expected_version") + 1
    )


def undo_latest(
    lineage: DataFrame,
    moment: Column,
    dataset: str = "dataset_id",
    user: str = "user_id",
    only: Column | None = None,
) -> DataFrame:
    """The lineage with the newest allowed change of every dataset and user undone.

    `only` limits the undo to some candidates, such as one dataset.
    """
    chosen = undo_candidates(lineage, dataset, user).filter("allowed")
    if only is not None:
        chosen = chosen.filter(only)
    marks = chosen.select(col(dataset), "id", F.lit(True).alias("_undo"))
    joined = lineage.join(marks, [dataset, "id"], "left")
    undone = F.coalesce("_undo", F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(undone, F.lit("undone")).otherwise(F.col("status")),
            "undone_at": F.when(undone, moment).otherwise(F.col("undone_at")),
        }
    ).select(*[col(c) for c in lineage.columns])


def undo_one(lineage: DataFrame, dataset_id, user_id, moment: Column) -> DataFrame:
    """Undo the newest change of one dataset; refused where there is none or it is not active."""
    mine = (F.col("dataset_id") == dataset_id) & (F.col("user_id") == user_id)
    candidate = undo_candidates(lineage.filter(F.col("dataset_id") == dataset_id)).filter(mine)
    found = candidate.select("allowed").first()
    if found is None:
        raise ValueError("Nothing to undo: no completed change is left.")
    if not found["allowed"]:
        raise ValueError("The newest change does not belong to the active version.")
    return undo_latest(lineage, moment, only=mine)


def export_active(
    spark: SparkSession, root: str, lineage: DataFrame, dataset_id, path: str, fmt: str
) -> int:
    """Write the active version of a dataset in the given format; return its number."""
    found = active_versions(lineage.filter(F.col("dataset_id") == dataset_id)).first()
    version = found["active_version"] if found else 1
    write_dataset(read_version(spark, root, version), path, fmt)
    return version
