"""Versions of a dataset with a commit log: changes by several writers, undo, and work after it.

A dataset is a folder. `data` holds one folder per version that was ever written, each with a name of
its own, so that nothing is overwritten, also not when a version's number is used again after an
undo. `log` holds one small JSON file per commit, numbered without gaps; a commit counts once its
file exists, and creating it is atomic and fails where it exists already. Of two writers that start
from the same commit therefore only one commits; the other one raises VersionConflict, and
its folder is left to the clean-up of unreferenced files.

What is active follows from the log alone. Rows and missing cells are counted while a version is
written, and those before a change are known from the commit before, so a change reads its input
once.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.columns import col
from quillgrid.operators.cleaning import apply_operation
from quillgrid.operators.rules import check_structure

LOG = (
    "id bigint, kind string, operation string, parameters string, user_id string,"
    " expected_version int, version int, path string, before_rows bigint, after_rows bigint,"
    " before_columns int, after_columns int, before_missing bigint, after_missing bigint,"
    " undoes bigint, created_at timestamp"
)


class VersionConflict(ValueError):
    """The dataset is not at the version that the change expected."""


@dataclass(frozen=True)
class State:
    """The last commit's number, and the active version with what is known of it."""

    last: int
    change: int
    user_id: str | None
    version: int
    path: str
    rows: int
    columns: int
    missing: int


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The commits of a dataset, one row each."""
    return spark.read.schema(LOG).json(f"{root.rstrip('/')}/log")


def state(spark: SparkSession, root: str) -> State:
    """The active version: that of the newest change that was not undone, else the first one."""
    log = read_log(spark, root)
    undone = log.where("kind = 'undo'").select(F.col("undoes").alias("id"))
    standing = log.where("kind <> 'undo'").join(undone, "id", "left_anti")
    newest = standing.agg(F.max(F.struct("version", *[c for c in log.columns if c != "version"])).alias("r"))
    row = newest.join(log.agg(F.max("id").alias("last"))).first()
    if row["last"] is None:
        raise ValueError(f"There is no dataset at {root}.")
    r = row["r"]
    return State(
        row["last"], r["id"], r["user_id"], r["version"], r["path"], r["after_rows"], r["after_columns"], r["after_missing"]
    )


def create(df: DataFrame, root: str, user_id: str | None = None, version: int = 1) -> State:
    """Write a table as the first version of a new dataset."""
    spark, root = df.sparkSession, root.rstrip("/")
    path, rows, missing = _written(check_structure(df), root, version)
    entry = {
        "id": 0, "kind": "create", "user_id": user_id, "version": version, "path": path,
        "after_rows": rows, "after_columns": len(df.columns), "after_missing": missing,
    }
    _commit(spark, root, entry, None)
    return state(spark, root)


def read_active(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(state(spark, root).path)


def change(
    spark: SparkSession, root: str, step: dict, user_id: str | None = None,
    expected_version: int | None = None, moment: str | None = None, based_on: State | None = None,
) -> State:
    """Apply a clean-up step to the active version and commit the result as the next one.

    `expected_version` is the version the caller has seen. `based_on` is a state read before; the
    commit fails if there is a newer one.
    """
    root = root.rstrip("/")
    now = based_on or state(spark, root)
    if expected_version is not None and expected_version != now.version:
        raise VersionConflict(f"Version {now.version} is active, not {expected_version}.")
    before = spark.read.parquet(now.path)
    after = check_structure(apply_operation(before, step["operation"], step.get("parameters")))
    path, rows, missing = _written(after, root, now.version + 1)
    entry = {
        "id": now.last + 1, "kind": "change", "operation": step["operation"],
        "parameters": json.dumps(step.get("parameters") or {}, sort_keys=True), "user_id": user_id,
        "expected_version": now.version, "version": now.version + 1, "path": path,
        "before_rows": now.rows, "after_rows": rows, "before_columns": now.columns,
        "after_columns": len(after.columns), "before_missing": now.missing, "after_missing": missing,
    }
    _commit(spark, root, entry, moment)
    return State(now.last + 1, now.last + 1, user_id, now.version + 1, path, rows, len(after.columns), missing)


def undo(
    spark: SparkSession, root: str, user_id: str | None = None, moment: str | None = None
) -> State:
    """Take back the change that made the active version; only its own user can."""
    now = state(spark, root)
    if now.change == 0:
        raise ValueError("Nothing to undo: no completed change is left.")
    if now.user_id != user_id:
        raise ValueError("The active version was made by another user.")
    entry = {"id": now.last + 1, "kind": "undo", "undoes": now.change, "user_id": user_id}
    _commit(spark, root.rstrip("/"), entry, moment)
    return state(spark, root)


def lineage(spark: SparkSession, root: str) -> DataFrame:
    """The changes of a dataset as lineage rows, with their status."""
    log = read_log(spark, root)
    undone = log.where("kind = 'undo'").select(F.col("undoes").alias("id"), F.col("created_at").alias("undone_at"))
    status = F.when(F.col("undone_at").isNotNull(), "undone").otherwise("completed")
    return log.where("kind = 'change'").drop("kind", "undoes").join(undone, "id", "left").withColumn("status", status)


def path_of(spark: SparkSession, root: str, version: int) -> str | None:
    """The folder of the newest commit of a version, if the dataset has a log with it."""
    if not _exists(spark, f"{root.rstrip('/')}/log"):
        return None
    found = read_log(spark, root).where(F.col("version") == version).agg(F.max_by("path", "id").alias("path"))
    return found.first()["path"]


def _written(df: DataFrame, root: str, version: int) -> tuple[str, int, int]:
    """Write a version to a new folder; the rows and missing cells are counted on the way."""
    path = f"{root}/data/{version:06d}-{uuid.uuid4().hex}"
    seen = Observation()
    present = sum((F.count(col(c)) for c in df.columns), F.lit(0))
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), present.alias("present"))
    counted.write.mode("errorifexists").parquet(path)
    rows = seen.get["rows"]
    return path, rows, rows * len(df.columns) - seen.get["present"]


def _commit(spark: SparkSession, root: str, entry: dict, moment: str | None) -> None:
    known = moment or spark.sql("SELECT string(current_timestamp()) AS t").first()["t"]
    line = json.dumps(entry | {"created_at": known}) + "\n"
    if not create_once(spark, f"{root}/log/{entry['id']:012d}.json", line):
        raise VersionConflict("Another change was committed first.")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all its content at once; False if it is there already.

    On this machine's file systems a link is made, elsewhere a file is renamed, which HDFS does only
    if the new name is free. An object store without that cannot hold the log of several writers.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    # A name with a dot at its start is not read as part of the log.
    name = f".{target.getName()}-{uuid.uuid4().hex}"
    if system.getUri().getScheme() == "file":
        local = system.makeQualified(target).toUri().getPath()
        held = os.path.join(os.path.dirname(local), name)
        with open(held, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(held, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(held)
        return True
    held = jvm.org.apache.hadoop.fs.Path(target.getParent(), name)
    out = system.create(held, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        done = not system.exists(target) and system.rename(held, target)
    finally:
        if system.exists(held):
            system.delete(held, False)
    return done


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def apply_steps(
    spark: SparkSession, root: str, steps: list[dict], user_id: str | None = None,
    moment: Column | str | None = None,
) -> State:
    """Commit several steps one after another, each as a version of its own."""
    now = state(spark, root)
    for step in steps:
        now = change(spark, root, step, user_id, based_on=now, moment=moment)
    return now
