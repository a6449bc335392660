"""Data-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import rules
from quillgrid.suite import GAPPY, gappy_events, query, table


def lineitem_rules():
    return {
        "known_flag": F.col("l_returnflag").isin("A", "N"),
        "quantity_range": F.col("l_quantity").between(0, 45),
        "tax_or_none": F.col("tax") >= 0.02,
    }


def ruled_items(spark, sf):
    """Line items whose tax is missing when shipped late."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_returnflag",
        "l_quantity",
        F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("tax"),
    )


RULED = """r AS (SELECT *, l_returnflag NOT IN ('A', 'N') AS flag,
    l_quantity NOT BETWEEN 0 AND 45 AS quantity,
    l_linestatus = 'O' AND l_tax < 0.02 AS low FROM lineitem)"""


@query(
    "rule_violations",
    f"""WITH {RULED} SELECT l_orderkey, l_linenumber, l_partkey,
        concat_ws('+', CASE WHEN flag THEN 'known_flag' END,
                  CASE WHEN quantity THEN 'quantity_range' END,
                  CASE WHEN low THEN 'tax_or_none' END) AS broken_rules
        FROM r WHERE flag OR quantity OR low""",
)
def rule_violations(spark, sf):
    found = rules.rule_violations(ruled_items(spark, sf), lineitem_rules())
    return found.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.array_join("broken_rules", "+").alias("broken_rules"),
    )


@query(
    "rule_counts",
    f"""WITH {RULED} SELECT 'known_flag' AS rule, count(*) FILTER (flag) AS violations FROM r
        UNION ALL SELECT 'quantity_range', count(*) FILTER (quantity) FROM r
        UNION ALL SELECT 'tax_or_none', count(*) FILTER (low) FROM r""",
)
def rule_counts(spark, sf):
    return rules.rule_counts(ruled_items(spark, sf), lineitem_rules())


@query(
    "rule_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
       GROUP BY ALL HAVING count(*) > 1""",
)
def rule_duplicate_keys(spark, sf):
    return rules.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "rule_duplicate_keys_missing",
    f"""WITH {GAPPY} SELECT user_id, event_type, count(*) AS rows FROM g
        WHERE event_type IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def rule_duplicate_keys_missing(spark, sf):
    return rules.duplicate_keys(gappy_events(spark, sf), ["user_id", "event_type"])


@query(
    "rule_shape",
    """SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, count(*) > 5000 AS too_many_rows
       FROM events""",
)
def rule_shape(spark, sf):
    return rules.shape(table(spark, sf, "events"), max_rows=5000)


@query(
    "rule_oversized_payloads",
    """SELECT doc_id, CAST(strlen(to_json({'lang': lang, 'text': text})) AS INTEGER)
              AS payload_bytes
       FROM documents WHERE strlen(to_json({'lang': lang, 'text': text})) > 2000""",
)
def rule_oversized_payloads(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    found = rules.oversized_payloads(documents, ["lang", "text"], 2000)
    return found.select("doc_id", "payload_bytes")


REQUESTS_SQL = """q AS (SELECT user_id, event_type, ts, event_id, floor(value / 10) AS tier,
    first_value(event_id) OVER w AS first_id, first_value(floor(value / 10)) OVER w AS first_tier
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def requests(spark, sf):
    """A request key is a user and event type; its payload is the value in steps of ten."""
    return table(spark, sf, "events").select(
        "user_id",
        "event_type",
        "ts",
        "event_id",
        F.floor(F.col("value") / 10).cast("double").alias("tier"),
    )


@query(
    "rule_oversized_escaped",
    r"""WITH j AS (SELECT doc_id, to_json({'doc_id': doc_id, 'text': text})::VARCHAR AS t FROM documents),
             s AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\x00-\x7E]', '', 'g')) AS plain,
                          length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS wide FROM j)
        SELECT doc_id, (plain + 6 * (n - plain + wide))::INT AS payload_bytes FROM s
        WHERE plain + 6 * (n - plain + wide) > 2000""",
)
def rule_oversized_escaped(spark, sf):
    """Results whose JSON is larger than a bound when everything beyond ASCII is escaped."""
    found = rules.oversized_payloads(table(spark, sf, "documents"), ["doc_id", "text"], 2000, escaped=True)
    return found.select("doc_id", "payload_bytes")


@query(
    "request_winners",
    f"""WITH {REQUESTS_SQL} SELECT user_id, event_type, min(first_id) AS event_id,
        min(first_tier) AS tier, count(*) AS requests, count(DISTINCT tier) > 1 AS conflict
        FROM q GROUP BY user_id, event_type""",
)
def request_winners(spark, sf):
    return rules.first_requests(
        requests(spark, sf), ["user_id", "event_type"], ["tier"], ["ts", "event_id"]
    ).drop("ts")


@query(
    "request_outcomes",
    f"""WITH {REQUESTS_SQL} SELECT event_id, CASE WHEN event_id = first_id THEN 'accepted'
        WHEN tier = first_tier THEN 'repeated' ELSE 'conflict' END AS outcome FROM q""",
)
def request_outcomes(spark, sf):
    return rules.request_outcomes(
        requests(spark, sf), ["user_id", "event_type"], ["tier"], ["ts", "event_id"]
    ).select("event_id", "outcome")
