"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "quillgrid", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC times and the given extra settings.

    On a cluster the launcher sets the master and memory; pass `master` only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that `spark.checkpoint.dir` names, which all executors share.

    None in a local session without that setting, as in tests, where a temporary folder of this
    machine will do; any other session is refused, as its executors could not read one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("Name a folder that all executors share in spark.checkpoint.dir.")
    return shared.rstrip("/") if shared else None


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    shared = shared_folder(spark)
    if shared:
        return f"{shared}/quillgrid-{label}-{uuid.uuid4().hex}"
    return os.path.join(tempfile.mkdtemp(prefix=f"quillgrid-{label}-"), "data")


def checkpointed(df: DataFrame) -> DataFrame:
    """The DataFrame written to the shared folder and read back; its partitions stay as they are."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(spark) or tempfile.mkdtemp(prefix="quillgrid-checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
