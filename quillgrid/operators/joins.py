"""Equi-joins over owner, dataset and change tables.

No join carries a broadcast hint: the sides grow with the catalog, so the choice is left to
the optimizer, which knows their sizes at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.columns import col


def owned_rows(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, owner: str, owner_id=None
) -> DataFrame:
    """Child rows with their owner; with `owner_id` only that owner's rows.

    Only the key and the owner of the parent travel through the join.
    """
    if owner_id is not None:
        parent = parent.filter(col(owner) == owner_id)
    parents = parent.select(col(parent_key).alias(child_key), col(owner).alias("owner_id"))
    return child.join(parents, child_key)


def owned_changes(
    changes: DataFrame, datasets: DataFrame, projects: DataFrame, keys: dict, owner_id=None
) -> DataFrame:
    """Change rows reached through dataset and project, with their owner.

    `keys` names `change_dataset`, `dataset`, `dataset_project`, `project` and `owner`.
    """
    mid = owned_rows(
        datasets.select(col(keys["dataset"]), col(keys["dataset_project"])),
        projects, keys["dataset_project"], keys["project"], keys["owner"], owner_id,
    )
    parents = mid.select(col(keys["dataset"]).alias(keys["change_dataset"]), "owner_id")
    return changes.join(parents, keys["change_dataset"])


def live_matches(
    left: DataFrame, right: DataFrame, on: list[tuple[str, str]], deleted_at: str | None = None
) -> DataFrame:
    """Inner join on several equalities, without rows the right side marks as deleted."""
    if deleted_at is not None:
        right = right.filter(col(deleted_at).isNull())
    condition = [left[a] == right[b] for a, b in on]
    return left.join(right, condition)


def backfill(
    child: DataFrame,
    parent: DataFrame,
    grandparent: DataFrame,
    keys: dict,
    from_parent: dict[str, str],
    from_grandparent: dict[str, str],
    zero_when_missing: list[str] = (),
) -> DataFrame:
    """Fill columns of a child from its parent and grandparent, keeping every child row.

    `from_parent` and `from_grandparent` map a new column to the column it comes from;
    `keys` names `child_parent`, `parent`, `parent_grandparent` and `grandparent`.
    """
    elders = grandparent.select(
        col(keys["grandparent"]).alias("_grandparent"),
        *[col(source).alias(name) for name, source in from_grandparent.items()],
    )
    parents = parent.select(
        col(keys["parent"]).alias("_parent"),
        col(keys["parent_grandparent"]).alias("_grandparent"),
        *[col(source).alias(name) for name, source in from_parent.items()],
    )
    looked_up = parents.join(elders, "_grandparent", "left").drop("_grandparent")
    filled = child.join(looked_up, child[keys["child_parent"]] == looked_up["_parent"], "left")
    filled = filled.drop("_parent")
    return filled.withColumns({c: F.coalesce(col(c), F.lit(0)) for c in zero_when_missing})


def unreferenced(
    files: DataFrame, references: DataFrame, key: str, cutoff: Column, modified: str = "modified"
) -> DataFrame:
    """Files no live record refers to that are older than the grace period."""
    old = files.filter(col(modified) < cutoff)
    return old.join(references.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; a NULL key refers to nothing and passes."""
    keys = parent.select(col(parent_key).alias(child_key))
    return child.filter(col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def split_by_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is listed (removed) and all others (kept)."""
    listed = keys.select(key)
    return df.join(listed, key, "left_semi"), df.join(listed, key, "left_anti")


def reconcile(
    entities: DataFrame,
    active: DataFrame,
    key: str,
    cutoff: Column,
    transitions: dict[str, str],
    message: str | None = None,
    status: str = "status",
    updated: str = "updated_at",
    clear: list[str] = (),
) -> DataFrame:
    """Give rows stuck in a working status their final one.

    A row is stuck if it is older than the cutoff and no active job owns its key; a row without
    a status is not. `transitions` maps a working status to the status it falls back to.
    """
    owners = active.select(col(key)).distinct().withColumn("_owned", F.lit(True))
    flagged = entities.join(owners, key, "left")
    stuck = (
        F.coalesce(col(status).isin(list(transitions)), F.lit(False))
        & F.col("_owned").isNull()
        & F.coalesce(col(updated) < cutoff, F.lit(False))
    )
    final = F.lit(None).cast("string")
    for before, after in transitions.items():
        final = F.when(col(status) == before, F.lit(after)).otherwise(final)
    error = col("error_message") if "error_message" in entities.columns else F.lit(None)
    changes = {
        status: F.when(stuck, final).otherwise(col(status)),
        "reconciled": stuck,
    }
    if message is not None:
        changes["error_message"] = F.when(stuck, F.lit(message)).otherwise(error.cast("string"))
    changes |= {c: F.when(~stuck, col(c)) for c in clear}
    return flagged.withColumns(changes).drop("_owned")


def settle_jobs(
    jobs: DataFrame, stale: Column, cancelling: str = "CANCELLATION_REQUESTED", message: str = ""
) -> DataFrame:
    """End stale jobs: a job asked to cancel is cancelled, any other one has failed.

    A failed job gets the message. All others keep theirs, and a job of which it is not known
    whether it is stale is left alone.
    """
    stale = F.coalesce(stale, F.lit(False))
    cancelled = F.coalesce(col("status") == cancelling, F.lit(False))
    error = col("error_message") if "error_message" in jobs.columns else F.lit(None)
    return jobs.withColumns(
        {
            "reconciled": stale,
            "error_message": F.when(stale & ~cancelled, F.lit(message)).otherwise(
                error.cast("string")
            ),
            "status": F.when(stale & cancelled, F.lit("CANCELLED"))
            .when(stale, F.lit("FAILURE"))
            .otherwise(col("status")),
        }
    )


def follow_jobs(
    targets: DataFrame, ended: DataFrame, key: str, final: tuple[str, ...], failed: str = "failed"
) -> DataFrame:
    """Move the target rows of ended jobs to the job's outcome, unless already final.

    `ended` holds one row per target key with a `cancelled` flag.
    """
    joined = targets.join(ended.select(key, "cancelled"), key, "left")
    open_target = F.col("cancelled").isNotNull() & ~col("status").isin(list(final))
    outcome = F.when(F.col("cancelled"), F.lit("cancelled")).otherwise(F.lit(failed))
    return joined.withColumn(
        "status", F.when(open_target, outcome).otherwise(col("status"))
    ).drop("cancelled")


def live_references(
    datasets: DataFrame, changes: DataFrame, reports: DataFrame, active: DataFrame
) -> DataFrame:
    """`path`, distinct: the stored files that some record still needs.

    The file of a dataset that is neither cancelled nor deleted, the input of every change, the
    output of a completed or undone change, or of an open one whose task is `active`, and the
    file of a completed report. Missing and empty paths name nothing.
    """
    kept = col("deleted_at").isNull() & F.coalesce(col("status") != "cancelled", F.lit(True))
    running = changes.filter(col("status").isin("pending", "processing")).join(
        active.select("task_id"), "task_id", "left_semi"
    )
    done = changes.filter(col("status").isin("completed", "undone"))
    paths = [
        datasets.filter(kept).select(col("stored_path").alias("path")),
        changes.select(col("input_path").alias("path")),
        done.select(col("output_path").alias("path")),
        running.select(col("output_path").alias("path")),
        reports.filter(col("status") == "completed").select(col("file_path").alias("path")),
    ]
    return reduce(DataFrame.unionByName, paths).filter(F.col("path") != "").distinct()


def settle_datasets(
    datasets: DataFrame, ended: DataFrame, changes: DataFrame, moment: Column
) -> DataFrame:
    """Datasets after jobs ended: `ended` has kind, dataset_id, change_id and `cancelled`.

    An ended import leaves the dataset cancelled, and deleted at the moment, or failed. An ended
    profile makes a dataset that is still profiling ready. An ended change that is neither
    completed nor undone releases the dataset if this still has the version the change expected.
    """
    open_changes = changes.filter(~F.coalesce(col("status").isin("completed", "undone"), F.lit(False)))
    expected = open_changes.select(col("id").alias("change_id"), "expected_version")
    facts = (
        ended.join(expected, "change_id", "left")
        .groupBy("dataset_id")
        .agg(
            F.bool_or((F.col("kind") == "import") & F.col("cancelled")).alias("_cancelled"),
            F.bool_or((F.col("kind") == "import") & ~F.col("cancelled")).alias("_failed"),
            F.bool_or(F.col("kind") == "profile").alias("_profiled"),
            F.collect_set(
                F.when(F.col("kind") == "transformation", F.col("expected_version"))
            ).alias("_versions"),
        )
        .withColumnRenamed("dataset_id", "id")
    )
    joined = datasets.join(facts, "id", "left")
    released = F.coalesce(F.array_contains("_versions", col("version")), F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(F.col("_cancelled"), F.lit("cancelled"))
            .when(F.col("_failed"), F.lit("failed"))
            .when(F.col("_profiled") & (col("status") == "profiling"), F.lit("ready"))
            .when(released, F.lit("ready"))
            .otherwise(col("status")),
            "deleted_at": F.when(F.col("_cancelled"), moment).otherwise(col("deleted_at")),
        }
    ).drop("_cancelled", "_failed", "_profiled", "_versions")


def settle_outcomes(
    targets: DataFrame, ended: DataFrame, key: str, final: tuple[str, ...], message: str,
    clear: tuple[str, ...] = (),
) -> DataFrame:
    """Changes or reports after their jobs ended, unless already final.

    They are cancelled without a message or failed with one; `clear` columns (the file of a
    report) are emptied. `ended` holds one row per key with a `cancelled` flag.
    """
    joined = targets.join(ended.select(key, F.col("cancelled").alias("_cancelled")), key, "left")
    is_final = F.coalesce(col("status").isin(list(final)), F.lit(False))
    moved = F.col("_cancelled").isNotNull() & ~is_final
    failed = moved & ~F.col("_cancelled")
    return joined.withColumns(
        {
            "status": F.when(failed, F.lit("failed")).when(moved, F.lit("cancelled")).otherwise(col("status")),
            "error_message": F.when(failed, F.lit(message)).when(~moved, col("error_message")),
            **{c: F.when(~moved, col(c)) for c in clear},
        }
    ).drop("_cancelled")
