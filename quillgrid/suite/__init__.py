"""The registered queries: every operator over the given tables, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.sources.readers import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FAMILIES = (
    "charts", "filters", "profiles", "cleaning", "joins", "rules", "scalars", "stored",
    "lineage", "windows",
)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, where: dict | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", where)


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing keys (sign-ups) and missing values (errors and small ones)."""
    events = table(spark, sf_dir, "events")
    return events.withColumns(
        {
            "value": F.when((F.col("event_type") != "error") & (F.col("value") >= 5), F.col("value")),
            "event_type": F.when(F.col("event_type") != "signup", F.col("event_type")),
        }
    )


GAPPY = """g AS (
    SELECT event_id, ts, user_id, props,
           CASE WHEN event_type <> 'signup' THEN event_type END AS event_type,
           CASE WHEN event_type <> 'error' AND value >= 5 THEN value END AS value
    FROM events)"""


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"quillgrid.suite.{family}")
