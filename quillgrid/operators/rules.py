"""Data rules: domains, uniqueness, schema bounds, payload size and repeated requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.columns import col

# The widest table and the longest column name a dataset may have.
MAX_COLUMNS = 1_000
MAX_NAME_CHARS = 256


def _broken(rule: Column) -> Column:
    """A rule is broken only where it is false; NULL passes, as in a SQL CHECK."""
    return F.coalesce(~rule, F.lit(False))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The offending rows, with the names of the rules each one breaks."""
    names = F.filter(
        F.array(*[F.when(_broken(rule), F.lit(name)) for name, rule in rules.items()]),
        lambda name: name.isNotNull(),
    )
    broken = reduce(lambda a, b: a | b, [_broken(rule) for rule in rules.values()])
    return df.filter(broken).withColumn("broken_rules", names)


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`rule, violations` for every rule, counted in one pass."""
    counts = df.agg(*[F.count_if(_broken(rule)).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a NULL part is exempt, as in SQL."""
    known = df.na.drop(subset=keys).groupBy(*[col(k) for k in keys])
    return known.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_structure(
    df: DataFrame, max_columns: int = MAX_COLUMNS, max_name_chars: int = MAX_NAME_CHARS
) -> DataFrame:
    """Raise if the table is too wide or a column name is too long; else return it."""
    if len(df.columns) > max_columns:
        raise ValueError(f"The table has {len(df.columns):,} columns, {max_columns:,} are the most.")
    long = next((c for c in df.columns if len(c) > max_name_chars), None)
    if long is not None:
        raise ValueError(f"Column {long[:40]}... has a name of more than {max_name_chars:,} letters.")
    return df


def shape(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """`rows, columns` of a checked table, and with `max_rows` whether it has too many rows."""
    check_structure(df)
    rows = F.count(F.lit(1))
    columns = [rows.alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns")]
    if max_rows is not None:
        columns.append((rows > max_rows).alias("too_many_rows"))
    return df.agg(*columns)


def payload_bytes(*columns: str, escaped: bool = False) -> Column:
    """Size in bytes of the compact JSON text of the named columns; `escaped` counts DEL and characters beyond
    ASCII as the escapes of their UTF-16 units."""
    text = F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})
    if not escaped:
        return F.octet_length(text)
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7E]", ""))
    two_units = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return plain + 6 * (F.length(text) - plain + two_units)


def oversized_payloads(
    df: DataFrame, columns: list[str], limit: int, escaped: bool = False
) -> DataFrame:
    sized = df.withColumn("payload_bytes", payload_bytes(*columns, escaped=escaped))
    return sized.filter(F.col("payload_bytes") > limit)


def first_requests(
    requests: DataFrame, keys: list[str], payload: list[str], order: list[str]
) -> DataFrame:
    """One row per request key: the first request, how often it came, and any conflict.

    Sending the same payload again is a repeat; sending another payload under the same key
    is a conflict. Everything is a plain aggregate that tasks reduce before the shuffle.
    """
    sent = F.struct(*[col(c) for c in payload])
    first = F.min(F.struct(*[col(c) for c in order], sent.alias("_payload")))
    grouped = requests.groupBy(*[col(k) for k in keys]).agg(
        first.alias("_first"),
        F.count(F.lit(1)).alias("requests"),
        F.min(sent).alias("_low"),
        F.max(sent).alias("_high"),
    )
    return grouped.select(
        *[col(k) for k in keys],
        *[F.col("_first")[c].alias(c) for c in order],
        *[F.col("_first")["_payload"][c].alias(c) for c in payload],
        "requests",
        (~F.col("_low").eqNullSafe(F.col("_high"))).alias("conflict"),
    )


def request_outcomes(
    requests: DataFrame, keys: list[str], payload: list[str], order: list[str]
) -> DataFrame:
    """Every request with its outcome: `accepted`, `repeated` or `conflict`."""
    winners = first_requests(requests, keys, payload, order).select(
        *[col(k) for k in keys],
        F.struct(*[col(c) for c in order]).alias("_at"),
        F.struct(*[col(c) for c in payload]).alias("_payload"),
    )
    same = F.struct(*[col(c) for c in payload]).eqNullSafe(F.col("_payload"))
    outcome = (
        F.when(F.struct(*[col(c) for c in order]) == F.col("_at"), F.lit("accepted"))
        .when(same, F.lit("repeated"))
        .otherwise(F.lit("conflict"))
    )
    return requests.join(winners, keys).withColumn("outcome", outcome).drop("_at", "_payload")
