"""Join, integrity, retention, reconciliation and rollup queries.

Customers stand for projects (their nation is the owner), orders for datasets and line
items for changes to them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import joins, ranking, rollups
from quillgrid.operators.filters import stale_condition
from quillgrid.session import work_folder
from quillgrid.sources import inventory
from quillgrid.suite import query, table


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "join_owned_rows",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_nationkey AS owner_id
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7""",
)
def join_owned_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer")
    return joins.owned_rows(orders, customers, "o_custkey", "c_custkey", "c_nationkey", 7)


CHAIN_KEYS = {
    "change_dataset": "l_orderkey",
    "dataset": "o_orderkey",
    "dataset_project": "o_custkey",
    "project": "c_custkey",
    "owner": "c_nationkey",
}


@query(
    "join_owned_changes",
    """SELECT l_orderkey, l_partkey, l_linenumber, c_nationkey AS owner_id
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey""",
)
def join_owned_changes(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return joins.owned_changes(
        items, table(spark, sf, "orders"), table(spark, sf, "customer"), CHAIN_KEYS
    )


@query(
    "join_live_matches",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders
       ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus
       WHERE o_orderpriority <> '5-LOW'""",
)
def join_live_matches(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "deleted_at", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    )
    matched = joins.live_matches(
        table(spark, sf, "lineitem"),
        orders,
        [("l_orderkey", "o_orderkey"), ("l_linestatus", "o_orderstatus")],
        "deleted_at",
    )
    return matched.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


@query(
    "join_backfill",
    """WITH live AS (SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END
                     AS row_count FROM orders WHERE o_orderstatus <> 'P')
       SELECT l_orderkey, l_linenumber, l_partkey, c_nationkey AS user_id,
              'orders/' || o_orderkey AS input_path, 'orders/' || o_orderkey AS output_path,
              coalesce(row_count, 0) AS before_rows, coalesce(row_count, 0) AS after_rows
       FROM lineitem LEFT JOIN live ON l_orderkey = o_orderkey
       LEFT JOIN customer ON o_custkey = c_custkey""",
)
def join_backfill(spark, sf):
    live = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        "o_orderkey",
        "o_custkey",
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("stored_path"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("row_count"),
    )
    return joins.backfill(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
        live,
        table(spark, sf, "customer"),
        {
            "child_parent": "l_orderkey",
            "parent": "o_orderkey",
            "parent_grandparent": "o_custkey",
            "grandparent": "c_custkey",
        },
        from_parent={
            "input_path": "stored_path",
            "output_path": "stored_path",
            "before_rows": "row_count",
            "after_rows": "row_count",
        },
        from_grandparent={"user_id": "c_nationkey"},
        zero_when_missing=["before_rows", "after_rows"],
    )


@query(
    "join_unreferenced_files",
    """SELECT 'orders/' || o_orderkey AS path FROM orders
       WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey NOT IN
             (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def join_unreferenced_files(spark, sf):
    def path(key):
        return F.concat(F.lit("orders/"), F.col(key).cast("string")).alias("path")

    files = table(spark, sf, "orders").select(path("o_orderkey"), F.col("o_orderdate").alias("modified"))
    references = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(path("l_orderkey"))
    return joins.unreferenced(files, references, "path", moment("2000-01-01")).select("path")


@query(
    "join_orphans",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_linestatus = 'F' AND l_orderkey NOT IN
             (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def join_orphans(spark, sf):
    """Line items of unfinished status refer to nothing: their key is missing and passes."""
    items = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", F.col("l_orderkey")).alias("l_orderkey"),
        "l_linenumber",
        "l_partkey",
    )
    parents = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return joins.orphans(items, parents, "l_orderkey", "o_orderkey")


EXPIRED_SQL = """expired AS (SELECT o_orderkey FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '1998-01-01'
    ORDER BY o_orderdate, o_orderkey LIMIT 3000)"""


def expired_orders(spark, sf):
    orders = table(spark, sf, "orders")
    ended = F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") < moment("1998-01-01"))
    return ranking.oldest_batch(orders, ended, "o_orderdate", "o_orderkey", 3000)


@query(
    "join_retention_split",
    f"""WITH {EXPIRED_SQL}
        SELECT 'removed' AS side, o_orderkey FROM orders SEMI JOIN expired USING (o_orderkey)
        UNION ALL
        SELECT 'kept', o_orderkey FROM orders ANTI JOIN expired USING (o_orderkey)""",
)
def join_retention_split(spark, sf):
    keys = expired_orders(spark, sf)
    removed, kept = joins.split_by_keys(
        table(spark, sf, "orders").select("o_orderkey"), keys, "o_orderkey"
    )
    return removed.select(F.lit("removed").alias("side"), "o_orderkey").unionByName(
        kept.select(F.lit("kept").alias("side"), "o_orderkey")
    )


@query(
    "join_retention_children",
    f"""WITH {EXPIRED_SQL}
        SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM expired)""",
)
def join_retention_children(spark, sf):
    keys = expired_orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.split_by_keys(items, keys, "l_orderkey")[1]


@query(
    "join_reconcile",
    """WITH active AS (SELECT DISTINCT l_orderkey FROM lineitem
                       WHERE l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2000-01-01'),
       s AS (SELECT o_orderkey, o_orderstatus, o_orderstatus IN ('O', 'P')
                    AND o_orderdate < TIMESTAMP '1999-01-01'
                    AND o_orderkey NOT IN (SELECT l_orderkey FROM active) AS stuck FROM orders)
       SELECT o_orderkey,
              CASE WHEN stuck AND o_orderstatus = 'O' THEN 'ready'
                   WHEN stuck THEN 'failed' ELSE o_orderstatus END AS status,
              stuck AS reconciled, CASE WHEN stuck THEN 'timed out' END AS error_message
       FROM s""",
)
def join_reconcile(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderdate"
    )
    active = table(spark, sf, "lineitem").filter(
        (F.col("l_linestatus") == "O") & (F.col("l_shipdate") >= moment("2000-01-01"))
    )
    return joins.reconcile(
        orders,
        active.select(F.col("l_orderkey").alias("o_orderkey")),
        "o_orderkey",
        moment("1999-01-01"),
        {"O": "ready", "P": "failed"},
        message="timed out",
        updated="o_orderdate",
    ).drop("o_orderdate")


@query(
    "join_settle_jobs",
    """WITH j AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1997-01-01' AS stale
                  FROM orders),
       ended AS (SELECT o_orderkey, o_orderstatus = 'O' AS cancelled FROM j WHERE stale)
       SELECT l_orderkey, l_linenumber, l_partkey,
              CASE WHEN cancelled IS NULL OR l_returnflag = 'N' THEN l_returnflag
                   WHEN cancelled THEN 'cancelled' ELSE 'failed' END AS status
       FROM lineitem LEFT JOIN ended ON l_orderkey = o_orderkey""",
)
def join_settle_jobs(spark, sf):
    """Stale jobs end, and the line items they worked on take over the outcome."""
    cutoff = moment("1997-01-01")
    jobs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"),
    )
    stale = stale_condition(cutoff, cutoff, waiting=("P",), running=("O",))
    ended = joins.settle_jobs(jobs, stale, cancelling="O", message="timed out")
    ended = ended.filter("reconciled").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("status") == "CANCELLED").alias("cancelled")
    )
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("status")
    )
    return joins.follow_jobs(items, ended, "l_orderkey", final=("N",))


@query(
    "join_settled_messages",
    """SELECT o_orderkey,
              o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1997-01-01' AS reconciled,
              CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN o_orderstatus
                   WHEN o_orderstatus = 'O' THEN 'CANCELLED' WHEN o_orderstatus = 'P' THEN 'FAILURE'
                   ELSE o_orderstatus END AS status,
              CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'timed out'
                   WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS error_message
       FROM orders""",
)
def join_settled_messages(spark, sf):
    """Only jobs that fail get the message; stored ones stay."""
    cutoff = moment("1997-01-01")
    jobs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("error_message"),
    )
    stale = stale_condition(cutoff, cutoff, waiting=("P",), running=("O",))
    settled = joins.settle_jobs(jobs, stale, cancelling="O", message="timed out")
    return settled.select("o_orderkey", "reconciled", "status", "error_message")


SETTLE_SQL = """items AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag),
    d AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'profiling' ELSE 'transforming' END AS status,
                 o_custkey % 3 + 1 AS version FROM orders),
    c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 3 + 1 AS expected_version,
                 CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'failed' END AS status,
                 CASE WHEN l_quantity < 10 THEN 'old' END AS error_message, 'v' || l_partkey AS output_path FROM items),
    e AS (SELECT l_orderkey AS dataset_id, l_quantity > 40 AS cancelled,
                 CASE l_linenumber % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'profile' ELSE 'transformation' END AS kind,
                 CASE WHEN l_linenumber % 4 > 1 THEN l_orderkey * 10 + l_linenumber END AS change_id
          FROM items WHERE l_shipdate < TIMESTAMP '1995-01-01')"""


def settled_inputs(spark, sf):
    """Orders stand for datasets, line items for changes and for the jobs on them that ended."""
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "profiling")
    datasets = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), status.otherwise("transforming").alias("status"),
        (F.col("o_custkey") % 3 + 1).alias("version"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"]
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct(*order)).alias("r")
    ).select("l_orderkey", "l_linenumber", "r.*")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    state = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "pending")
    changes = items.select(
        number.alias("id"), (F.col("l_linenumber") % 3 + 1).alias("expected_version"), state.otherwise("failed").alias("status"),
        F.when(F.col("l_quantity") < 10, "old").alias("error_message"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("output_path"),
    )
    quarter = F.col("l_linenumber") % 4
    ended = items.where(F.col("l_shipdate") < moment("1995-01-01")).select(
        F.col("l_orderkey").alias("dataset_id"), (F.col("l_quantity") > 40).alias("cancelled"),
        F.when(quarter == 0, "import").when(quarter == 1, "profile").otherwise("transformation").alias("kind"),
        F.when(quarter > 1, number).alias("change_id"),
    )
    return datasets, changes, ended


@query(
    "join_settle_datasets",
    f"""WITH {SETTLE_SQL}, f AS (
            SELECT dataset_id, bool_or(kind = 'import' AND e.cancelled) AS cancelled, bool_or(kind = 'import' AND NOT e.cancelled) AS failed,
                   bool_or(kind = 'profile') AS profiled,
                   list(expected_version) FILTER (kind = 'transformation' AND c.status <> 'completed') AS versions
            FROM e LEFT JOIN c ON c.id = change_id GROUP BY dataset_id)
        SELECT d.id, CASE WHEN cancelled THEN 'cancelled' WHEN failed THEN 'failed'
                          WHEN profiled AND status = 'profiling' THEN 'ready'
                          WHEN list_contains(versions, version) THEN 'ready' ELSE status END AS status,
               CASE WHEN cancelled THEN TIMESTAMP '2030-01-01' END AS deleted_at
        FROM d LEFT JOIN f ON dataset_id = d.id""",
)
def join_settle_datasets(spark, sf):
    """Datasets after jobs of each kind ended."""
    datasets, changes, ended = settled_inputs(spark, sf)
    settled = joins.settle_datasets(datasets, ended, changes, moment("2030-01-01").cast("timestamp_ntz"))
    return settled.select("id", "status", "deleted_at")


@query(
    "join_settle_outcomes",
    f"""WITH {SETTLE_SQL}, m AS (SELECT c.*, e.cancelled, e.cancelled IS NOT NULL AND c.status <> 'completed' AS moved
                                 FROM c LEFT JOIN e ON change_id = id)
        SELECT id, CASE WHEN moved AND cancelled THEN 'cancelled' WHEN moved THEN 'failed' ELSE status END AS status,
               CASE WHEN moved AND NOT cancelled THEN 'timed out' WHEN NOT moved THEN error_message END AS error_message,
               CASE WHEN NOT moved THEN output_path END AS output_path FROM m""",
)
def join_settle_outcomes(spark, sf):
    """Changes after their jobs ended: cancelled without a message, failed with one, files emptied."""
    _, changes, ended = settled_inputs(spark, sf)
    by_change = ended.where("change_id IS NOT NULL").select(F.col("change_id").alias("id"), "cancelled")
    settled = joins.settle_outcomes(changes, by_change, "id", ("completed", "undone"), "timed out", ("output_path",))
    return settled.select("id", "status", "error_message", "output_path")


@query(
    "storage_quota",
    """WITH s AS (SELECT c_nationkey AS owner_id, sum(strlen(c_name) + 1) AS bytes FROM customer GROUP BY c_nationkey)
       SELECT owner_id, 2::BIGINT AS files, bytes::BIGINT AS used_bytes, bytes > 1150 AS over_quota,
              bytes + 10 * owner_id <= 1150 AS fits FROM s""",
)
def storage_quota(spark, sf):
    """Stored files with their real sizes, one of each owner is missing; bytes that are to come."""
    folder = work_folder(spark, "stored")
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("owner"))
    customers.repartition("owner").write.partitionBy("owner").text(folder)
    stored = inventory.file_inventory(spark, folder, "part-*")
    owner = F.regexp_extract("path", "owner=([0-9]+)/", 1).cast("bigint").alias("owner_id")
    references = stored.select(owner, "path")
    gone = references.select("owner_id", F.concat(F.lit(folder), F.lit("/gone/"), F.col("owner_id").cast("string")).alias("path"))
    every = references.unionByName(gone).unionByName(references).distinct()
    return rollups.storage_per_owner(every, stored, quota=1150, incoming=F.col("owner_id") * 10)


@query(
    "count_by_status",
    """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed,
              count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""",
)
def count_by_status(spark, sf):
    kind = F.col("event_type")
    return rollups.status_counts(
        table(spark, sf, "events"), kind == "purchase", kind == "error", ["user_id"]
    )


@query(
    "count_by_status_overall",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed,
              count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders""",
)
def count_by_status_overall(spark, sf):
    status = F.col("o_orderstatus")
    return rollups.status_counts(table(spark, sf, "orders"), status == "F", status == "P")


@query(
    "count_active_per_owner",
    """SELECT o_custkey, count(*) AS active, count(*) >= 8 AS at_capacity FROM orders
       WHERE o_orderstatus IN ('O', 'P') AND o_orderkey <> 17 GROUP BY o_custkey""",
)
def count_active_per_owner(spark, sf):
    return rollups.active_per_owner(
        table(spark, sf, "orders"),
        ["O", "P"],
        cap=8,
        owner="o_custkey",
        status="o_orderstatus",
        exclude=F.col("o_orderkey") == 17,
    )


REFERENCES_SQL = """refs AS (
    SELECT o_custkey AS owner_id, 'orders/' || o_orderkey AS path FROM orders
    UNION SELECT o_custkey, 'orders/' || l_orderkey FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey
    UNION SELECT o_custkey, 'parts/' || l_partkey FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'
    UNION SELECT c_custkey, 'reports/' || c_mktsegment FROM customer)"""


def reference_sources(spark, sf):
    def path(folder, key):
        return F.concat(F.lit(folder + "/"), F.col(key).cast("string"))

    orders = table(spark, sf, "orders")
    datasets = orders.select("o_custkey", path("orders", "o_orderkey").alias("stored_path"))
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        path("orders", "l_orderkey").alias("input_path"),
        F.when(F.col("l_returnflag") != "N", path("parts", "l_partkey")).alias("output_path"),
    )
    changes = joins.owned_rows(items, orders, "l_orderkey", "o_orderkey", "o_custkey")
    reports = table(spark, sf, "customer").select(
        "c_custkey", path("reports", "c_mktsegment").alias("file_path")
    )
    return [
        (datasets, "o_custkey", ["stored_path"]),
        (changes, "owner_id", ["input_path", "output_path"]),
        (reports, "c_custkey", ["file_path"]),
    ]


@query("union_of_references", f"WITH {REFERENCES_SQL} SELECT DISTINCT path FROM refs")
def union_of_references(spark, sf):
    sources = [(df, None, columns) for df, _, columns in reference_sources(spark, sf)]
    return rollups.distinct_references(sources)


@query(
    "storage_per_owner",
    f"""WITH {REFERENCES_SQL},
        files AS (SELECT 'orders/' || o_orderkey AS path, o_custkey + 100 AS size FROM orders
                  UNION ALL SELECT 'parts/' || p_partkey, CAST(p_size AS BIGINT) FROM part)
        SELECT owner_id, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS used_bytes,
               sum(coalesce(size, 0)) > 12000 AS over_quota
        FROM refs LEFT JOIN files USING (path) GROUP BY owner_id""",
)
def storage_per_owner(spark, sf):
    """Reports have no stored file, so they count as 0 bytes."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"),
        (F.col("o_custkey") + 100).alias("size"),
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_size").cast("bigint").alias("size"),
    )
    references = rollups.distinct_references(reference_sources(spark, sf))
    return rollups.storage_per_owner(references, orders.unionByName(parts), quota=12_000)


@query(
    "join_live_references",
    """WITH d AS (SELECT 'd' || o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'cancelled' ELSE 'ready' END AS status,
                         CASE WHEN o_totalprice < 50000 THEN o_orderdate END AS deleted_at FROM orders),
       c AS (SELECT 'd' || l_orderkey AS i, 'v' || l_partkey AS o,
                    CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'failed' END AS status,
                    l_suppkey AS task_id FROM lineitem WHERE l_quantity < 3),
       r AS (SELECT 'r' || event_id AS path, event_type AS status FROM events)
       SELECT path FROM d WHERE status <> 'cancelled' AND deleted_at IS NULL
       UNION SELECT i FROM c UNION SELECT o FROM c WHERE status = 'completed'
       UNION SELECT o FROM c WHERE status = 'pending' AND task_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
       UNION SELECT path FROM r WHERE status = 'purchase'""",
)
def join_live_references(spark, sf):
    """Orders stand for datasets, line items of small quantity for changes, events for reports."""
    status = F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("ready")
    datasets = table(spark, sf, "orders").select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("stored_path"),
        status.alias("status"),
        F.when(F.col("o_totalprice") < 50_000, F.col("o_orderdate")).alias("deleted_at"),
    )
    state = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "pending")
    changes = table(spark, sf, "lineitem", {"l_quantity": {"lte": 2}}).select(
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("input_path"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("output_path"),
        state.otherwise("failed").alias("status"),
        F.col("l_suppkey").alias("task_id"),
    )
    kind = F.when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    reports = table(spark, sf, "events").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("file_path"), kind.alias("status")
    )
    active = table(spark, sf, "supplier").filter("s_acctbal > 5000")
    return joins.live_references(
        datasets, changes, reports, active.select(F.col("s_suppkey").alias("task_id"))
    )
