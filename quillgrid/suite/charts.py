"""Chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.plans import charts
from quillgrid.suite import GAPPY, gappy_events, query, table


def rounded(df, digits=2):
    return df.withColumn("value", F.round(F.col("value").cast("double"), digits))


ORDERS_BAR = {
    "chart_type": "bar",
    "x_column": "o_orderpriority",
    "y_column": "o_totalprice",
    "aggregation": "sum",
    "filters": {"o_totalprice": {"gte": 100000}},
}


@query(
    "chart_bar_filtered_sum",
    """SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value
       FROM orders WHERE o_totalprice >= 100000 GROUP BY 1""",
)
def chart_bar_filtered_sum(spark, sf):
    orders = table(spark, sf, "orders", where=ORDERS_BAR["filters"])
    return rounded(charts.build_chart(orders, ORDERS_BAR))


def _series(aggregation, expression, digits):
    sql = f"""WITH {GAPPY}, s AS (
        SELECT event_type, {expression} AS value FROM g GROUP BY event_type)
        SELECT coalesce(event_type, 'nan') AS label, value FROM s WHERE value IS NOT NULL"""

    @query(f"chart_series_{aggregation}", sql)
    def run(spark, sf):
        spec = {
            "chart_type": "line",
            "x_column": "event_type",
            "y_column": "value",
            "aggregation": aggregation,
        }
        chart = charts.build_chart(gappy_events(spark, sf), spec)
        return chart if aggregation == "count" else rounded(chart, digits)


_series("sum", "round(coalesce(sum(value), 0), 2)", 2)
_series("mean", "round(avg(value), 9)", 9)
_series("count", "count(value)", 0)
_series("min", "min(value)", 2)
_series("max", "max(value)", 2)


@query(
    "chart_scatter_first_groups",
    """SELECT CAST(user_id AS VARCHAR) AS label, round(avg(value), 9) AS value
       FROM events GROUP BY user_id ORDER BY user_id LIMIT 100""",
)
def chart_scatter_first_groups(spark, sf):
    spec = {
        "chart_type": "scatter",
        "x_column": "user_id",
        "y_column": "value",
        "aggregation": "mean",
    }
    return rounded(charts.build_chart(table(spark, sf, "events"), spec), 9)


@query(
    "chart_series_number_keys",
    """SELECT CAST(l_discount AS VARCHAR) AS label, round(sum(l_extendedprice), 2) AS value
       FROM lineitem GROUP BY l_discount""",
)
def chart_series_number_keys(spark, sf):
    items = table(spark, sf, "lineitem")
    return rounded(charts.grouped_series(items, "l_discount", "l_extendedprice"))


@query(
    "chart_pie_measure",
    """SELECT CAST(p_size AS VARCHAR) AS label, round(sum(p_retailprice), 2) AS value
       FROM part GROUP BY p_size ORDER BY p_size LIMIT 20""",
)
def chart_pie_measure(spark, sf):
    spec = {"chart_type": "pie", "x_column": "p_size", "y_column": "p_retailprice"}
    return rounded(charts.build_chart(table(spark, sf, "part"), spec))


@query(
    "chart_pie_counts",
    """SELECT source AS label, count(*) AS value FROM documents
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def chart_pie_counts(spark, sf):
    return charts.build_chart(
        table(spark, sf, "documents"), {"chart_type": "pie", "x_column": "source"}
    )


@query(
    "chart_pie_counts_missing",
    f"""WITH {GAPPY} SELECT coalesce(event_type, 'nan') AS label, count(*) AS value
        FROM g GROUP BY 1""",
)
def chart_pie_counts_missing(spark, sf):
    return charts.category_counts(gappy_events(spark, sf), "event_type")


@query(
    "chart_kpi_each",
    f"""WITH {GAPPY}
        SELECT 'sum' AS label, round(sum(value), 2) AS value FROM g
        UNION ALL SELECT 'mean', round(avg(value), 9) FROM g
        UNION ALL SELECT 'count', CAST(count(value) AS DOUBLE) FROM g
        UNION ALL SELECT 'min', min(value) FROM g
        UNION ALL SELECT 'max', max(value) FROM g""",
)
def chart_kpi_each(spark, sf):
    titles = {aggregation: aggregation for aggregation in charts.AGGREGATIONS}
    return rounded_figures(charts.key_figures(gappy_events(spark, sf), "value", titles))


def rounded_figures(figures):
    """Means to nine digits and all else to two: sums of doubles depend on their order."""
    mean = F.col("label").startswith("mean")
    value = F.when(mean, F.round("value", 9)).otherwise(F.round("value", 2))
    return figures.withColumn("value", value)


@query(
    "chart_kpi_nothing_left",
    """SELECT 'sum' AS label, CAST(0 AS DOUBLE) AS value
       UNION ALL SELECT 'mean', avg(value) FROM events WHERE event_type = 'none'
       UNION ALL SELECT 'count', CAST(count(value) AS DOUBLE) FROM events
                 WHERE event_type = 'none'""",
)
def chart_kpi_nothing_left(spark, sf):
    events = table(spark, sf, "events")
    result = None
    for aggregation in ("sum", "mean", "count"):
        spec = {
            "chart_type": "kpi",
            "y_column": "value",
            "aggregation": aggregation,
            "title": aggregation,
            "filters": {"event_type": {"eq": "none"}},
        }
        one = rounded(charts.build_chart(events, spec))
        result = one if result is None else result.unionByName(one)
    return result


@query(
    "chart_table",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_totalprice <= 250000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def chart_table(spark, sf):
    orders = table(spark, sf, "orders", where={"o_totalprice": {"lte": 250000}}).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    spec = {"chart_type": "table", "filters": {"o_totalprice": {"lte": 250000}}}
    return charts.build_chart(orders, spec, order)


def histogram_sql(source: str, column: str) -> str:
    """Right-closed bins; the least edge is lowered by 0.1 % of the range."""
    return f"""
    WITH v AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL),
    b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    r AS (SELECT lo, hi, lo = hi AS flat,
                 CASE WHEN lo < hi THEN lo WHEN lo = 0 THEN -CAST(0.001 AS DOUBLE)
                      ELSE lo - abs(lo) * CAST(0.001 AS DOUBLE) END AS a,
                 CASE WHEN lo < hi THEN hi WHEN lo = 0 THEN CAST(0.001 AS DOUBLE)
                      ELSE hi + abs(hi) * CAST(0.001 AS DOUBLE) END AS z
          FROM b),
    e AS (SELECT i, CASE WHEN i = 0 AND NOT flat THEN a - (z - a) * CAST(0.001 AS DOUBLE)
                         WHEN i = 10 THEN z ELSE a + i * ((z - a) / 10) END AS edge
          FROM r, generate_series(0, 10) AS s(i)),
    p AS (SELECT i, edge, CASE WHEN edge = 0 OR abs(edge) >= 1 THEN 3
                               ELSE 2 - floor(log10(abs(edge))) END AS digits FROM e),
    t AS (SELECT i, CAST(round_even(edge * pow(10, digits), 0) / pow(10, digits) AS VARCHAR)
                    AS shown FROM p),
    k AS (SELECT CASE WHEN flat THEN 4 ELSE len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9],
                      lambda i: v > lo + i * ((hi - lo) / 10))) END AS bin, count(*) AS n
          FROM v, r GROUP BY 1)
    SELECT '(' || l.shown || ', ' || u.shown || ']' AS label, coalesce(n, 0) AS value
    FROM t l JOIN t u ON u.i = l.i + 1 LEFT JOIN k ON k.bin = l.i"""


@query("chart_histogram_discount", histogram_sql("lineitem", "l_discount"))
def chart_histogram_discount(spark, sf):
    spec = {"chart_type": "histogram", "x_column": "l_discount"}
    return charts.build_chart(table(spark, sf, "lineitem"), spec)


@query("chart_histogram_price", histogram_sql("orders", "o_totalprice"))
def chart_histogram_price(spark, sf):
    return charts.histogram(table(spark, sf, "orders"), "o_totalprice")


@query("chart_histogram_integers", histogram_sql("part", "p_size"))
def chart_histogram_integers(spark, sf):
    return charts.histogram(table(spark, sf, "part"), "p_size")


@query(
    "chart_histogram_gaps",
    histogram_sql("(SELECT CASE WHEN value >= 5 THEN value END AS value FROM events)", "value"),
)
def chart_histogram_gaps(spark, sf):
    events = table(spark, sf, "events").select(
        F.when(F.col("value") >= 5, F.col("value")).alias("value")
    )
    return charts.histogram(events, "value")


@query(
    "chart_histogram_constant",
    histogram_sql("(SELECT l_linenumber * 0 + 7.5 AS c FROM lineitem)", "c"),
)
def chart_histogram_constant(spark, sf):
    constant = table(spark, sf, "lineitem").select((F.col("l_linenumber") * 0 + 7.5).alias("c"))
    return charts.histogram(constant, "c")


def shown_number(expression: str) -> str:
    return rf"regexp_replace(format('{{:,.2f}}', round({expression}, 2)), '\.?0+$', '')"


def lenient_histogram_sql(source: str, value: str) -> str:
    return f"""
    WITH v AS (SELECT {value} AS v FROM {source}),
    b AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 10 AS w FROM v),
    k AS (SELECT least(9, CAST(floor((v - lo) / w) AS INTEGER)) AS bin, count(*) AS n
          FROM v, b WHERE v IS NOT NULL GROUP BY 1)
    SELECT {shown_number("lo + w * i")} || '–' ||
           CASE WHEN i = 9 THEN {shown_number("hi")} ELSE {shown_number("lo + w * (i + 1)")} END
           AS label, coalesce(n, 0) AS value
    FROM b, generate_series(0, 9) AS s(i) LEFT JOIN k ON k.bin = i"""


@query(
    "lenient_histogram_text",
    lenient_histogram_sql(
        "lineitem", "CASE WHEN l_linenumber < 7 THEN CAST(l_extendedprice AS DOUBLE) END"
    ),
)
def lenient_histogram_text(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("string"))
        .otherwise(F.lit("n/a"))
        .alias("price")
    )
    return charts.build_chart_lenient(items, "price", "price", "count", "histogram")


@query("lenient_histogram_quantity", lenient_histogram_sql("lineitem", "l_quantity"))
def lenient_histogram_quantity(spark, sf):
    return charts.histogram_lenient(table(spark, sf, "lineitem"), "l_quantity")


@query(
    "lenient_histogram_single",
    "SELECT CAST(min(c) AS VARCHAR) AS label, count(*) AS value"
    " FROM (SELECT l_linenumber * 0 + 12 AS c FROM lineitem)",
)
def lenient_histogram_single(spark, sf):
    constant = table(spark, sf, "lineitem").select((F.col("l_linenumber") * 0 + 12).alias("c"))
    return charts.histogram_lenient(constant, "c")


LENIENT = """t AS (
    SELECT CASE WHEN event_type <> 'signup' THEN event_type ELSE 'Unknown' END AS label,
           CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"""


def lenient_events(spark, sf):
    """Keys missing for sign-ups; measures as text, which is no number for errors."""
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("kind"),
        F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.col("value").cast("string")))
        .otherwise(F.col("props"))
        .alias("amount"),
    )


def _lenient(aggregation, expression, digits=4):
    sql = f"""WITH {LENIENT}, s AS (SELECT label, {expression} AS value FROM t GROUP BY label)
              SELECT * FROM s WHERE value IS NOT NULL"""

    @query(f"lenient_group_{aggregation}", sql)
    def run(spark, sf):
        chart = charts.grouped_lenient(lenient_events(spark, sf), "kind", "amount", aggregation)
        return chart if aggregation == "count" else rounded(chart, digits)


_lenient("sum", "round(coalesce(sum(v), 0), 4)")
_lenient("mean", "round(avg(v), 9)", 9)
_lenient("count", "count(v)")
_lenient("min", "min(v)")
_lenient("max", "max(v)")


@query(
    "lenient_kpi",
    f"""WITH {LENIENT}
        SELECT 'sum of amount' AS label, round(sum(v), 2) AS value FROM t
        UNION ALL SELECT 'mean of amount', round(avg(v), 9) FROM t
        UNION ALL SELECT 'count of amount', CAST(count(v) AS DOUBLE) FROM t
        UNION ALL SELECT 'min of amount', min(v) FROM t
        UNION ALL SELECT 'max of amount', max(v) FROM t""",
)
def lenient_kpi(spark, sf):
    events = lenient_events(spark, sf)
    return rounded_figures(charts.key_figures_lenient(events, "amount", charts.AGGREGATIONS))


@query(
    "chart_shares",
    """WITH s AS (SELECT c_mktsegment AS label, greatest(sum(c_acctbal - 4500), 0) AS value
                  FROM customer GROUP BY 1 ORDER BY 1 LIMIT 8)
       SELECT label, round(value, 2) AS value,
              round(value / (SELECT sum(value) FROM s) * 100, 1) AS percent FROM s""",
)
def chart_shares(spark, sf):
    customers = table(spark, sf, "customer").withColumn("over", F.col("c_acctbal") - 4500)
    return rounded(charts.shares(charts.grouped_series(customers, "c_mktsegment", "over")))
