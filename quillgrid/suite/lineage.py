"""Preview, version and lineage queries.

Line items stand for lineage rows: their order is the dataset, the supplier the user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators.cleaning import apply_steps
from quillgrid.plans import lineage, versions
from quillgrid.session import work_folder
from quillgrid.sources import readers
from quillgrid.suite import GAPPY, gappy_events, query, table
from quillgrid.suite.cleaning import PIPELINE, PIPELINE_SQL


@query(
    "preview_step_counts",
    f"""WITH {GAPPY}, s AS (SELECT event_type, value, user_id FROM g),
        d AS (SELECT DISTINCT * FROM s)
        SELECT 'before' AS side, count(*) AS rows, CAST(3 AS BIGINT) AS columns,
               3 * count(*) - count(event_type) - count(value) - count(user_id) AS missing_cells
        FROM s UNION ALL
        SELECT 'after', count(*), CAST(3 AS BIGINT),
               3 * count(*) - count(event_type) - count(value) - count(user_id) FROM d""",
)
def preview_step_counts(spark, sf):
    events = gappy_events(spark, sf).select("event_type", "value", "user_id")
    return lineage.preview_counts(events, "drop_duplicates")


@query(
    "preview_step_sample",
    f"""WITH {GAPPY} SELECT event_id, coalesce(value, 0) AS value, props FROM g
        ORDER BY event_id LIMIT 20""",
)
def preview_step_sample(spark, sf):
    events = gappy_events(spark, sf).select("event_id", "value", "props")
    fill = {"values": {"value": 0}}
    return lineage.preview_sample(events, "fill_nulls", fill, [F.col("event_id").asc()])


@query(
    "preview_step_hidden",
    "SELECT 4 AS columns_truncated, CAST(greatest(count(*) - 20, 0) AS BIGINT) AS rows_hidden FROM events",
)
def preview_step_hidden(spark, sf):
    fill = {"values": {"value": 0}}
    return lineage.preview_hidden(gappy_events(spark, sf), "fill_nulls", fill, columns=2)


LINEAGE_SQL = f"""{PIPELINE_SQL}, n AS (
    SELECT (SELECT count(*) FROM g) AS all_rows,
           (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, amount FROM f)) AS kept),
    steps(step, operation, before_columns, after_columns) AS (VALUES
        (0, 'fill_nulls', 6, 6), (1, 'drop_columns', 6, 3), (2, 'cast_types', 3, 3),
        (3, 'rename_columns', 3, 3), (4, 'drop_duplicates', 3, 3))
    SELECT step, operation, step + 1 AS expected_version, all_rows AS before_rows,
           CASE WHEN step = 4 THEN kept ELSE all_rows END AS after_rows,
           before_columns, after_columns, 'completed' AS status FROM steps, n"""


@query("lineage_of_steps", LINEAGE_SQL)
def lineage_of_steps(spark, sf):
    return lineage.apply_with_lineage(gappy_events(spark, sf), PIPELINE)[1].drop("parameters")


@query("lineage_of_written_versions", LINEAGE_SQL)
def lineage_of_written_versions(spark, sf):
    root = work_folder(spark, "versions")
    return lineage.apply_and_write(gappy_events(spark, sf), PIPELINE, root).drop("parameters")


def change_rows(spark, sf):
    """Line items as lineage rows, one per order and line number."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("user_id"),
        F.min("l_returnflag").alias("flag"),
        F.sum("l_quantity").cast("bigint").alias("before_rows"),
        F.min("l_quantity").cast("bigint").alias("after_rows"),
        F.min("l_shipdate").alias("created_at"),
    )
    return items.select(
        F.col("l_orderkey").alias("dataset_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linenumber").alias("expected_version"),
        "user_id",
        F.when(F.col("flag") == "N", "undone")
        .when(F.col("flag") == "R", "failed")
        .otherwise("completed")
        .alias("status"),
        F.when(F.col("flag") == "N", F.col("created_at")).alias("undone_at"),
        "before_rows",
        "after_rows",
        "created_at",
    )


CHANGES_SQL = """c AS (
    SELECT l_orderkey AS dataset_id, l_orderkey * 10 + l_linenumber AS id,
           l_linenumber AS expected_version, min(l_suppkey) AS user_id,
           CASE min(l_returnflag) WHEN 'N' THEN 'undone' WHEN 'R' THEN 'failed'
                ELSE 'completed' END AS status,
           CASE WHEN min(l_returnflag) = 'N' THEN min(l_shipdate) END AS undone_at,
           CAST(sum(l_quantity) AS BIGINT) AS before_rows,
           CAST(min(l_quantity) AS BIGINT) AS after_rows, min(l_shipdate) AS created_at
    FROM lineitem GROUP BY l_orderkey, l_linenumber),
    a AS (SELECT dataset_id, coalesce(max(CASE WHEN status = 'completed'
          THEN expected_version + 1 END), 1) AS active_version FROM c GROUP BY dataset_id),
    u AS (SELECT dataset_id, user_id, id, expected_version + 1 = active_version AS allowed
          FROM c JOIN a USING (dataset_id) WHERE status = 'completed' AND undone_at IS NULL
          QUALIFY row_number() OVER (PARTITION BY dataset_id, user_id
                                     ORDER BY created_at DESC, id DESC) = 1)"""


@query(
    "lineage_history",
    f"WITH {CHANGES_SQL} SELECT id, status, before_rows - after_rows AS row_delta FROM c",
)
def lineage_history(spark, sf):
    return lineage.history(change_rows(spark, sf)).select("id", "status", "row_delta")


@query("lineage_active_versions", f"WITH {CHANGES_SQL} SELECT * FROM a")
def lineage_active_versions(spark, sf):
    return lineage.active_versions(change_rows(spark, sf))


@query("lineage_undo_candidates", f"WITH {CHANGES_SQL} SELECT * FROM u")
def lineage_undo_candidates(spark, sf):
    return lineage.undo_candidates(change_rows(spark, sf)).select(
        "dataset_id", "user_id", "id", "allowed"
    )


@query(
    "lineage_undo_latest",
    f"""WITH {CHANGES_SQL} SELECT c.dataset_id, c.id,
        CASE WHEN allowed THEN 'undone' ELSE status END AS status,
        CASE WHEN allowed THEN TIMESTAMP '2030-01-01' ELSE undone_at END AS undone_at
        FROM c LEFT JOIN u ON u.id = c.id""",
)
def lineage_undo_latest(spark, sf):
    moment = F.lit("2030-01-01").cast("timestamp_ntz")
    return lineage.undo_latest(change_rows(spark, sf), moment).select(
        "dataset_id", "id", "status", "undone_at"
    )


@query(
    "version_snapshots",
    f"""WITH {GAPPY} SELECT 1 AS version, event_id, value FROM g
        UNION ALL SELECT 2, event_id, coalesce(value, 0) FROM g""",
)
def version_snapshots(spark, sf):
    """An older version stays as it was when a newer one is written."""
    root = work_folder(spark, "versions")
    events = gappy_events(spark, sf).select("event_id", "value")
    step = {"operation": "fill_nulls", "parameters": {"values": {"value": 0}}}
    lineage.write_version(events, root, 1)
    lineage.write_version(apply_steps(lineage.read_version(spark, root, 1), [step]), root, 2)
    return spark.read.parquet(root).select("version", "event_id", "value")


@query(
    "version_export_after_undo",
    f"""WITH {GAPPY} SELECT DISTINCT coalesce(event_type, 'none') AS event_type, user_id FROM g""",
)
def version_export_after_undo(spark, sf):
    """Three versions are written, the last change is undone, and version two is exported."""
    root, out = work_folder(spark, "versions"), work_folder(spark, "export")
    steps = [
        {"operation": "fill_nulls", "parameters": {"values": {"event_type": "none"}}},
        {"operation": "drop_duplicates"},
        {"operation": "drop_columns", "parameters": {"columns": ["user_id"]}},
    ]
    written = lineage.apply_and_write(
        gappy_events(spark, sf).select("event_type", "user_id"), steps, root
    )
    rows = written.select(
        F.lit(1).alias("dataset_id"),
        F.lit(1).alias("user_id"),
        F.col("step").alias("id"),
        "expected_version",
        "status",
        F.lit(None).cast("timestamp").alias("undone_at"),
        F.timestamp_seconds(F.col("step")).alias("created_at"),
    )
    undone = lineage.undo_one(rows, 1, 1, F.now())
    lineage.export_active(spark, root, undone, 1, out, "csv")
    return readers.read_csv(spark, out)


TWO_STEPS = [
    {"operation": "fill_nulls", "parameters": {"values": {"event_type": "none", "value": 0}}},
    {"operation": "drop_duplicates"},
]


def changed_after_undo(spark, sf):
    """Two changes, an undo of the second, and another second change."""
    root = work_folder(spark, "versions")
    versions.create(gappy_events(spark, sf).select("event_type", "user_id", "value"), root, "ann")
    versions.apply_steps(spark, root, TWO_STEPS, "ann")
    versions.undo(spark, root, "ann")
    versions.change(spark, root, {"operation": "drop_columns", "parameters": {"columns": ["value"]}}, "ben", 2)
    versions.change(spark, root, {"operation": "drop_duplicates"}, "ann", 3)
    return root


@query(
    "version_change_after_undo",
    f"WITH {GAPPY} SELECT DISTINCT coalesce(event_type, 'none') AS event_type, user_id FROM g",
)
def version_change_after_undo(spark, sf):
    return versions.read_active(spark, changed_after_undo(spark, sf))


@query(
    "version_log",
    f"""WITH {GAPPY}, f AS (SELECT coalesce(event_type, 'none') AS event_type, user_id, coalesce(value, 0) AS value FROM g),
        n AS (SELECT (SELECT count(*) FROM g) AS r, (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS d,
                     (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM f)) AS u,
                     (SELECT 2 * count(*) - count(event_type) - count(value) FROM g) AS m)
        SELECT id, operation, user_id, expected_version, version, status, before_rows, after_rows, before_missing FROM n,
        LATERAL (VALUES (1, 'fill_nulls', 'ann', 1, 2, 'completed', r, r, m), (2, 'drop_duplicates', 'ann', 2, 3, 'undone', r, d, 0),
                        (4, 'drop_columns', 'ben', 2, 3, 'completed', r, r, 0), (5, 'drop_duplicates', 'ann', 3, 4, 'completed', r, u, 0))
                AS t(id, operation, user_id, expected_version, version, status, before_rows, after_rows, before_missing)""",
)
def version_log(spark, sf):
    return versions.lineage(spark, changed_after_undo(spark, sf)).select(
        F.col("id").cast("int").alias("id"), "operation", "user_id", "expected_version", "version", "status",
        "before_rows", "after_rows", "before_missing",
    )
