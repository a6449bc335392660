"""Filter rules and the predicates used by maintenance queries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import col, is_numeric, type_of
from quillgrid.functions.scalars import value_text


def _comparable(dtype: T.DataType, value) -> bool:
    """Whether a rule value and a column can be compared without changing either's meaning."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if is_numeric(dtype):
        return number or isinstance(value, bool)
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    return not number and not isinstance(value, bool)


def _literal(dtype: T.DataType, value) -> Column:
    return F.lit(int(value)) if isinstance(value, bool) and is_numeric(dtype) else F.lit(value)


def equals(df: DataFrame, column: str, value) -> Column:
    if value is None or not _comparable(type_of(df, column), value):
        return F.lit(False)
    return col(column) == _literal(type_of(df, column), value)


def at_least(df: DataFrame, column: str, value) -> Column:
    if not _comparable(type_of(df, column), value):
        raise ValueError(f"Column '{column}' cannot be compared with {value!r}.")
    return col(column) >= _literal(type_of(df, column), value)


def at_most(df: DataFrame, column: str, value) -> Column:
    if not _comparable(type_of(df, column), value):
        raise ValueError(f"Column '{column}' cannot be compared with {value!r}.")
    return col(column) <= _literal(type_of(df, column), value)


def contains_text(df: DataFrame, column: str, value) -> Column:
    """Case-insensitive literal substring of the column's text form; NULL never matches."""
    text = value_text(col(column), type_of(df, column))
    return F.lower(text).contains(str(value).lower())


RULES = {"eq": equals, "gte": at_least, "lte": at_most, "contains": contains_text}


def rules_condition(df: DataFrame, filters: dict) -> Column:
    """All rules joined by AND; unknown columns and rules that are no objects are ignored."""
    conditions = [
        RULES[key](df, column, rule[key])
        for column, rule in filters.items()
        if column in df.columns and isinstance(rule, dict)
        for key in RULES
        if key in rule
    ]
    return reduce(and_, conditions) if conditions else F.lit(True)


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    return df.filter(rules_condition(df, filters)) if filters else df


def active_rows(
    df: DataFrame, statuses: list[str], status: str = "status", deleted_at: str = "deleted_at"
) -> DataFrame:
    """Rows in one of the statuses that carry no deletion time."""
    return df.filter(col(status).isin(statuses) & col(deleted_at).isNull())


def stale_condition(
    now: Column,
    cutoff: Column,
    status: str = "status",
    updated: str = "updated_at",
    lease: str = "lease_expires_at",
    waiting: tuple[str, ...] = ("PENDING",),
    running: tuple[str, ...] = ("STARTED", "CANCELLATION_REQUESTED"),
) -> Column:
    """Waiting too long, or running with a lease that ended or never was and no update."""
    old = col(updated) < cutoff
    lease_over = (col(lease) <= now) | (col(lease).isNull() & old)
    waits = col(status).isin(list(waiting)) & old
    runs = col(status).isin(list(running)) & lease_over
    return F.coalesce(waits | runs, F.lit(False))
