"""Clean-up step queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import cleaning
from quillgrid.suite import GAPPY, gappy_events, query, table


@query("clean_drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def clean_drop_columns(spark, sf):
    customers = table(spark, sf, "customer")
    return cleaning.drop_columns(customers, ["c_name", "c_mktsegment"])


@query(
    "clean_rename_columns",
    "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment"
    " FROM customer",
)
def clean_rename_columns(spark, sf):
    mapping = {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}
    return cleaning.rename_columns(table(spark, sf, "customer"), mapping)


@query(
    "clean_fill_nulls",
    f"""WITH {GAPPY} SELECT event_id, coalesce(event_type, 'none') AS event_type,
        coalesce(value, -1) AS value FROM g""",
)
def clean_fill_nulls(spark, sf):
    events = gappy_events(spark, sf).select("event_id", "event_type", "value")
    return cleaning.fill_nulls(events, {"event_type": "none", "value": -1})


@query(
    "clean_fill_nulls_widening",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_returnflag <> 'R' THEN CAST(l_linenumber AS DOUBLE) ELSE 0.5 END
              AS number,
              CASE WHEN l_returnflag <> 'R' THEN CAST(l_tax AS VARCHAR) ELSE 'free' END AS tax
       FROM lineitem""",
)
def clean_fill_nulls_widening(spark, sf):
    kept = F.col("l_returnflag") != "R"
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(kept, F.col("l_linenumber")).alias("number"),
        F.when(kept, F.col("l_tax")).alias("tax"),
    )
    return cleaning.fill_nulls(items, {"number": 0.5, "tax": "free"})


@query(
    "clean_cast_types",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS DOUBLE)
              AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity,
              CAST(l_tax AS VARCHAR) AS l_tax FROM lineitem""",
)
def clean_cast_types(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return cleaning.cast_types(
        items,
        {
            "l_orderkey": "string",
            "l_linenumber": "float64",
            "l_quantity": "int64",
            "l_tax": "string",
        },
    )


@query(
    "clean_cast_from_text",
    """SELECT o_orderkey, o_totalprice AS price, o_orderdate AS day,
              CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer FROM orders""",
)
def clean_cast_from_text(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderdate").cast("string").alias("day"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("customer"),
    )
    cast = cleaning.cast_types(
        orders, {"price": "float64", "day": "datetime64[ns]", "customer": "Int64"}
    )
    return cast.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "clean_drop_duplicates",
    "SELECT DISTINCT event_type, user_id FROM events",
)
def clean_drop_duplicates(spark, sf):
    return cleaning.drop_duplicates(table(spark, sf, "events").select("event_type", "user_id"))


@query("clean_drop_duplicates_gaps", f"WITH {GAPPY} SELECT DISTINCT event_type, value FROM g")
def clean_drop_duplicates_gaps(spark, sf):
    return cleaning.apply_operation(
        gappy_events(spark, sf).select("event_type", "value"), "drop_duplicates"
    )


@query(
    "clean_fill_lenient",
    f"""WITH {GAPPY} SELECT event_id, coalesce(value, 2.5) AS value FROM g""",
)
def clean_fill_lenient(spark, sf):
    events = gappy_events(spark, sf).select("event_id", "value")
    return cleaning.fill_nulls_lenient(events, "value", " 2.5 ")


@query(
    "clean_cast_lenient",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR)
              ELSE props END AS DOUBLE) AS amount, CAST(user_id AS VARCHAR) AS user_id
       FROM events""",
)
def clean_cast_lenient(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value").cast("string"))
        .otherwise(F.col("props"))
        .alias("amount"),
        "user_id",
    )
    numbers = cleaning.cast_lenient(events, "amount", "number")
    return cleaning.cast_lenient(numbers, "user_id", "text")


PIPELINE = [
    {"operation": "fill_nulls", "parameters": {"values": {"event_type": "none", "value": 0}}},
    {"operation": "drop_columns", "parameters": {"columns": ["event_id", "ts", "props"]}},
    {"operation": "cast_types", "parameters": {"mapping": {"value": "int64"}}},
    {"operation": "rename_columns", "parameters": {"mapping": {"value": "amount"}}},
    {"operation": "drop_duplicates"},
]

PIPELINE_SQL = f"""WITH {GAPPY}, f AS (
    SELECT user_id, coalesce(event_type, 'none') AS event_type,
           CAST(trunc(coalesce(value, 0)) AS BIGINT) AS amount FROM g)"""


@query(
    "clean_steps_in_order",
    f"{PIPELINE_SQL} SELECT DISTINCT user_id, event_type, amount FROM f",
)
def clean_steps_in_order(spark, sf):
    return cleaning.apply_steps(gappy_events(spark, sf), PIPELINE)


@query(
    "clean_steps_from_form",
    """SELECT c_custkey, c_name AS c_name_renamed, c_nationkey,
              CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""",
)
def clean_steps_from_form(spark, sf):
    """A rename, a cast to text and a fill of a column without gaps, one after another."""
    steps = [
        {"operation": "rename_columns", "parameters": {"mapping": {"c_name": "c_name_renamed"}}},
        {"operation": "cast_types", "parameters": {"mapping": {"c_acctbal": "string"}}},
        {"operation": "fill_nulls", "parameters": {"values": {"c_nationkey": cleaning.lenient_value("0")}}},
    ]
    return cleaning.apply_steps(table(spark, sf, "customer"), steps)


MAPS = "SELECT event_id % 50 AS id, event_type, user_id % 3 AS extra, event_id % 2 AS later FROM events"


@query(
    "clean_drop_duplicates_maps",
    f"""SELECT id, event_type, 2 + extra AS entries, later, TIMESTAMP '2024-01-01' + to_microseconds(later) AS moment
        FROM ({MAPS}) GROUP BY ALL""",
)
def clean_drop_duplicates_maps(spark, sf):
    """Maps that hold times a microsecond apart differ; the order of their entries does not matter."""
    events = table(spark, sf, "events")
    moment = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id") % 2 / F.lit(1_000_000))
    extra = F.col("user_id") % 3
    more = F.transform(F.sequence(F.lit(0), extra.cast("int")), lambda i: F.struct(i.cast("string").alias("k"), moment.alias("v")))
    flipped = F.when(F.col("event_id") % 4 < 2, F.reverse(more)).otherwise(more)
    pairs = F.concat(flipped, F.array(F.struct(F.lit("m").alias("k"), moment.alias("v"))))
    rows = events.select(
        (F.col("event_id") % 50).alias("id"), "event_type", F.map_from_entries(pairs).alias("times"),
    )
    kept = cleaning.drop_duplicates(rows)
    return kept.select(
        "id", "event_type", F.size("times").cast("bigint").alias("entries"),
        (F.col("times")["m"] != F.lit("2024-01-01").cast("timestamp_ntz")).cast("bigint").alias("later"),
        F.col("times")["m"].alias("moment"),
    )
