"""Filter, projection, page and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import columns, filters, ranking
from quillgrid.session import work_folder
from quillgrid.suite import GAPPY, gappy_events, query, table


@query(
    "filter_eq",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def filter_eq(spark, sf):
    rules = {"o_orderstatus": {"eq": "F"}}
    return table(spark, sf, "orders", where=rules).select("o_orderkey", "o_totalprice")


@query("filter_eq_missing", f"WITH {GAPPY} SELECT event_id FROM g WHERE event_type = 'click'")
def filter_eq_missing(spark, sf):
    rules = {"event_type": {"eq": "click"}}
    return filters.apply_filters(gappy_events(spark, sf), rules).select("event_id")


@query(
    "filter_gte",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45",
)
def filter_gte(spark, sf):
    items = table(spark, sf, "lineitem", where={"l_quantity": {"gte": 45}})
    return items.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "filter_lte_time",
    "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'",
)
def filter_lte_time(spark, sf):
    rules = {"o_orderdate": {"lte": "1996-06-30 00:00:00"}}
    return table(spark, sf, "orders", where=rules).select("o_orderkey")


@query(
    "filter_contains",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'e.')",
)
def filter_contains(spark, sf):
    return filters.apply_filters(
        table(spark, sf, "documents"), {"text": {"contains": "E."}}
    ).select("doc_id")


@query(
    "filter_contains_number",
    "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem"
    " WHERE contains(CAST(l_tax AS VARCHAR), '.0')",
)
def filter_contains_number(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return filters.apply_filters(items, {"l_tax": {"contains": ".0"}})


@query(
    "filter_conjunction",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag = 'R'
         AND contains(lower(l_linestatus), 'o')""",
)
def filter_conjunction(spark, sf):
    rules = {
        "l_quantity": {"gte": 10, "lte": 20},
        "l_returnflag": {"eq": "R"},
        "l_linestatus": {"contains": "o"},
        "no_such_column": {"eq": 1},
        "l_tax": "no rule",
    }
    return table(spark, sf, "lineitem", where=rules).select("l_orderkey", "l_linenumber")


@query(
    "filter_active_rows",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')
       AND (CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END) IS NULL""",
)
def filter_active_rows(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "deleted_at", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    )
    return filters.active_rows(orders, ["O", "P"], status="o_orderstatus").select("o_orderkey")


@query(
    "filter_stale_records",
    """SELECT o_orderkey FROM (
         SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 100 DAY END
                   AS lease FROM orders)
       WHERE (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01')
          OR (o_orderstatus = 'O' AND (lease <= TIMESTAMP '2000-01-01'
              OR (lease IS NULL AND o_orderdate < TIMESTAMP '1999-01-01')))""",
)
def filter_stale_records(spark, sf):
    lease = F.when(
        F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")
    )
    stale = filters.stale_condition(
        now=F.lit("2000-01-01").cast("timestamp_ntz"),
        cutoff=F.lit("1999-01-01").cast("timestamp_ntz"),
        status="o_orderstatus",
        updated="o_orderdate",
        lease="lease",
        waiting=("P",),
        running=("O",),
    )
    return table(spark, sf, "orders").withColumn("lease", lease).filter(stale).select("o_orderkey")


@query("project_search", "SELECT l_partkey, l_orderkey, l_suppkey FROM lineitem")
def project_search(spark, sf):
    return columns.search_columns(table(spark, sf, "lineitem"), "KEY")


@query(
    "project_truncate",
    "SELECT l_orderkey, l_partkey, l_suppkey, 8 AS hidden FROM lineitem",
)
def project_truncate(spark, sf):
    shown, hidden = columns.truncate_columns(table(spark, sf, "lineitem"), 3)
    return shown.withColumn("hidden", F.lit(hidden))


@query(
    "preview_documents",
    """SELECT doc_id, lang, n_chars,
              CASE WHEN length(text) > 512 THEN substring(text, 1, 512) || '...' ELSE text END
              AS text,
              '<binary value: ' || strlen(source) || ' bytes>' AS raw
       FROM documents""",
)
def preview_documents(spark, sf):
    documents = table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars", "text", F.col("source").cast("binary").alias("raw")
    )
    return columns.preview_cells(documents)


@query(
    "preview_events",
    f"""WITH {GAPPY} SELECT event_id, user_id, event_type, value, props,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
            ELSE strftime(ts, '.%f') END AS ts FROM g""",
)
def preview_events(spark, sf):
    return columns.preview_cells(gappy_events(spark, sf))


@query(
    "page_of_rows",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def page_of_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.page(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3, 50)


@query(
    "page_of_rows_ranked",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 950""",
)
def page_of_rows_ranked(spark, sf):
    """A far page, of which only the pieces around it are read."""
    path = work_folder(spark, "ranked")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    ranking.write_ranked(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), order, path, 400)
    return ranking.ranked_page(spark, path, order, 20, 50)


@query(
    "page_of_rows_facts",
    """SELECT count(*) AS total_rows, 11 AS total_columns, 3 AS columns_truncated, 3 AS page,
              50 AS page_size FROM lineitem""",
)
def page_of_rows_facts(spark, sf):
    return ranking.page_facts(table(spark, sf, "lineitem"), 3, 50, width=8)


@query(
    "page_of_rows_after",
    """SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 50)
       ORDER BY o_custkey, o_orderkey LIMIT 100""",
)
def page_of_rows_after(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return ranking.page_after(orders, ["o_custkey", "o_orderkey"], (100, 50), 100)


@query("newest_first_ranked", """SELECT o_orderkey, row_number() OVER (
           ORDER BY CAST(o_orderdate AS VARCHAR) DESC, o_orderkey) - 1 AS place
       FROM orders ORDER BY place LIMIT 1000""")
def newest_first_ranked(spark, sf):
    """The first thousand of the newest, with the place each has in the result."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("day")
    )
    newest = ranking.newest_first(orders, "day", "o_orderkey").limit(1000).coalesce(1)
    return newest.select("o_orderkey", F.monotonically_increasing_id().alias("place"))


@query(
    "head_of_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
def head_of_rows(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    order = [F.col(k).asc() for k in keys]
    return ranking.head(table(spark, sf, "lineitem").select(*keys), order, 20)


@query("newest_first", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders")
def newest_first(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("day")
    )
    return ranking.newest_first(orders, "day", "o_orderkey")


@query(
    "oldest_batch",
    """SELECT event_id FROM events WHERE event_type = 'error'
       ORDER BY ts, event_id LIMIT 500""",
)
def oldest_batch(spark, sf):
    failed = F.col("event_type") == "error"
    return ranking.oldest_batch(
        table(spark, sf, "events"), failed, "ts", "event_id", 100_000, maximum=500
    ).select("event_id")


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
         FROM events WHERE event_type <> 'view') WHERE r = 1""",
)
def latest_per_key(spark, sf):
    seen = table(spark, sf, "events").filter(F.col("event_type") != "view")
    newest = ranking.latest_per_key(seen, ["user_id"], ["ts", "event_id"])
    return newest.select("user_id", "event_id", "event_type", "value")


@query(
    "latest_per_two_keys",
    """SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL""",
)
def latest_per_two_keys(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    newest = ranking.latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"])
    return newest.select("user_id", "event_type", "event_id")
