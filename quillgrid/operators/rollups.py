"""Counts and sums per owner, and the distinct union of referenced paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.columns import col
from quillgrid.sources.inventory import sizes_of


def status_counts(
    df: DataFrame, success: Column, failure: Column, by: list[str] | None = None
) -> DataFrame:
    """`total, completed, failed`, counted in one pass."""
    return df.groupBy(*[col(c) for c in by or []]).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(success).alias("completed"),
        F.count_if(failure).alias("failed"),
    )


def active_per_owner(
    jobs: DataFrame,
    statuses: list[str],
    cap: int,
    owner: str = "owner_id",
    status: str = "status",
    exclude: Column | None = None,
) -> DataFrame:
    """Active jobs per owner and whether the cap is reached; `exclude` leaves rows out."""
    active = jobs.filter(col(status).isin(statuses))
    if exclude is not None:
        active = active.filter(~exclude)
    counted = active.groupBy(col(owner)).agg(F.count(F.lit(1)).alias("active"))
    return counted.withColumn("at_capacity", F.col("active") >= cap)


def distinct_references(sources: list[tuple[DataFrame, str | None, list[str]]]) -> DataFrame:
    """Distinct paths named in any column of any table, per owner where one is given.

    Each source is (table, owner column or None, path columns) and is scanned once.
    """

    def paths(df: DataFrame, owner: str | None, columns: list[str]) -> DataFrame:
        keys = [col(owner).alias("owner_id")] if owner else []
        slim = df.select(*keys, *[col(c).alias(f"p{i}") for i, c in enumerate(columns)])
        ids = ["owner_id"] if owner else []
        long = slim.unpivot(ids, [f"p{i}" for i in range(len(columns))], "_from", "path")
        return long.filter(F.col("path").isNotNull() & (F.col("path") != "")).select(*ids, "path")

    return reduce(DataFrame.unionByName, [paths(*s) for s in sources]).distinct()


def storage_per_owner(
    references: DataFrame, inventory: DataFrame, quota: int, incoming: Column | None = None
) -> DataFrame:
    """Stored bytes per owner over distinct paths, and whether they exceed the quota.

    With `incoming` bytes (an expression over owner_id) also whether those still fit.
    """
    sized = sizes_of(references, inventory)
    used = sized.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("used_bytes")
    )
    used = used.withColumn("over_quota", F.col("used_bytes") > quota)
    if incoming is None:
        return used
    return used.withColumn("fits", F.col("used_bytes") + incoming <= quota)
