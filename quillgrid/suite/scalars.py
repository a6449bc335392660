"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import scalars
from quillgrid.suite import query, table
from quillgrid.suite.charts import shown_number


@query(
    "scalar_rounding",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              round_even(l_quantity / 4, 0) AS whole,
              round_even(l_extendedprice / 7, 2) AS cents,
              round_even(l_extendedprice / 7, 4) AS fine FROM lineitem""",
)
def scalar_rounding(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        scalars.half_even(F.col("l_quantity") / 4, 0).alias("whole"),
        scalars.half_even(F.col("l_extendedprice") / 7, 2).alias("cents"),
        scalars.half_even(F.col("l_extendedprice") / 7, 4).alias("fine"),
    )


@query(
    "scalar_cut_text",
    """SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text
              END AS short, substring(text, 1, 2000) AS message FROM documents""",
)
def scalar_cut_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        scalars.cut_text(F.col("text"), 40).alias("short"),
        scalars.text_prefix(F.col("text"), 2000).alias("message"),
    )


@query(
    "scalar_iso_time",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S')
                  || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS moment,
              strftime(ts, '%Y-%m-%d') AS day,
              strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS whole FROM events""",
)
def scalar_iso_time(spark, sf):
    ts = F.col("ts")
    day = ts.cast("date")
    return (
        table(spark, sf, "events")
        .select(
            "event_id",
            scalars.iso_text(ts).alias("moment"),
            scalars.iso_text(day, table(spark, sf, "events").select(day.alias("d")).schema["d"].dataType)
            .alias("day"),
            scalars.iso_text(F.date_trunc("second", ts)).alias("whole"),
        )
    )


@query(
    "scalar_byte_placeholder",
    "SELECT page_id, '<binary value: ' || strlen(html) || ' bytes>' AS shown FROM pages",
)
def scalar_byte_placeholder(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", scalars.byte_placeholder(F.col("html").cast("binary")).alias("shown")
    )


@query(
    "scalar_escape_markup",
    """SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
              AS safe FROM pages""",
)
def scalar_escape_markup(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", scalars.escape_markup(F.col("html")).alias("safe")
    )


@query(
    "scalar_display_number",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {shown_number('l_extendedprice * l_quantity')}"
    " AS shown FROM lineitem",
)
def scalar_display_number(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        scalars.display_number(F.col("l_extendedprice") * F.col("l_quantity")).alias("shown"),
    )


@query(
    "scalar_export_name",
    "SELECT c_custkey, 'processed-' || c_name || '.v1.csv' AS name FROM customer",
)
def scalar_export_name(spark, sf):
    path = F.concat(F.lit("data/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".v1.csv"))
    return table(spark, sf, "customer").select("c_custkey", scalars.export_name(path).alias("name"))


@query(
    "scalar_snake_to_words",
    "SELECT p_partkey, replace(replace(p_name, ' ', '_') || '_' || p_brand, '_', ' ') AS words"
    " FROM part",
)
def scalar_snake_to_words(spark, sf):
    snake = F.concat_ws("_", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "p_brand")
    return table(spark, sf, "part").select("p_partkey", scalars.snake_to_words(snake).alias("words"))


@query(
    "scalar_clamp_percent",
    "SELECT event_id, greatest(0, least(100, value - 20)) AS progress FROM events",
)
def scalar_clamp_percent(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", scalars.clamp_percent(F.col("value") - 20).alias("progress")
    )


@query(
    "scalar_older_than",
    """SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderdate < TIMESTAMP '1998-06-01' AS old
       FROM orders""",
)
def scalar_older_than(spark, sf):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    cutoff = F.lit("1998-06-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.older_than(known, cutoff).alias("old")
    )


@query(
    "scalar_as_number",
    """SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value * 0 + 1500
              END AS number FROM events""",
)
def scalar_as_number(spark, sf):
    """Plain and exponent forms are numbers; JSON, a type letter and infinity are not."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .when(kind == "view", F.lit("+1.5e3"))
        .when(kind == "error", F.concat(F.col("user_id").cast("string"), F.lit("d")))
        .when(kind == "signup", F.lit("1e999"))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", scalars.as_number(text).alias("number"))


@query(
    "scalar_double_text",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CAST(round(l_extendedprice * 1000) AS VARCHAR) AS large,
              CAST(l_discount / 1000 AS VARCHAR) AS small FROM lineitem""",
)
def scalar_double_text(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        scalars.double_text(F.round(F.col("l_extendedprice") * 1000)).alias("large"),
        scalars.double_text(F.col("l_discount") / 1000).alias("small"),
    )
