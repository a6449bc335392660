import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import joins, ranking, rollups
from quillgrid.operators.filters import active_rows, stale_condition

NOW = dt.datetime(2026, 1, 10)


def ago(**span):
    return NOW - dt.timedelta(**span)


def test_backfill(spark):
    users = [(5, 1)]
    projects = spark.createDataFrame(users, "id int, owner_id int")
    datasets = spark.createDataFrame([(2, 5, "a.csv", None)], "id int, project_id int, path string, n int")
    changes = spark.createDataFrame([(3, 2), (4, 99)], "id int, dataset_id int")
    filled = joins.backfill(
        changes,
        datasets,
        projects,
        {
            "child_parent": "dataset_id",
            "parent": "id",
            "parent_grandparent": "project_id",
            "grandparent": "id",
        },
        {"input_path": "path", "output_path": "path", "before_rows": "n", "after_rows": "n"},
        {"user_id": "owner_id"},
        ["before_rows", "after_rows"],
    )
    found = {r.id: r for r in filled.collect()}
    assert (found[3].user_id, found[3].input_path, found[3].output_path) == (1, "a.csv", "a.csv")
    assert (found[3].before_rows, found[3].after_rows) == (0, 0)
    assert (found[4].user_id, found[4].input_path, found[4].before_rows) == (None, None, 0)


def test_orphans(spark, rows):
    child = spark.createDataFrame([("missing-job", "import"), ("job", "x"), (None, "y")], "task_id string, kind string")
    parent = spark.createDataFrame([("job",), (None,)], "task_id string")
    assert rows(joins.orphans(child, parent, "task_id", "task_id")) == [("missing-job", "import")]


def test_unreferenced_files(spark, rows):
    files = spark.createDataFrame(
        [("old", ago(hours=48)), ("fresh", ago(hours=1)), ("used", ago(hours=48))],
        "path string, modified timestamp",
    )
    references = spark.createDataFrame([("used",), (None,)], "path string")
    found = joins.unreferenced(files, references, "path", F.lit(ago(hours=24)))
    assert [r.path for r in found.collect()] == ["old"]


def test_session_batches(spark):
    sessions = spark.createDataFrame(
        [("a", ago(hours=3)), ("b", ago(hours=2)), ("c", NOW + dt.timedelta(hours=1))],
        "jti string, expires_at timestamp",
    )
    expired = F.col("expires_at") <= F.lit(NOW)
    for batch, left in [(1, {"b", "c"}), (10, {"c"}), (0, {"b", "c"})]:
        keys = ranking.oldest_batch(sessions, expired, "expires_at", "jti", batch)
        _, kept = joins.split_by_keys(sessions, keys, "jti")
        assert {r.jti for r in kept.collect()} == left


def test_job_history_goes_with_its_children(spark):
    jobs = spark.createDataFrame(
        [("old", "SUCCESS", ago(days=31)), ("new", "SUCCESS", ago(days=1)), ("run", "STARTED", None)],
        "task_id string, status string, finished_at timestamp",
    )
    outbox = spark.createDataFrame([("old",), ("new",)], "task_id string")
    gone = F.col("status").isin("SUCCESS", "FAILURE") & (F.col("finished_at") < F.lit(ago(days=30)))
    keys = ranking.oldest_batch(jobs, gone, "finished_at", "task_id", 100)
    assert {r.task_id for r in joins.split_by_keys(jobs, keys, "task_id")[1].collect()} == {"new", "run"}
    assert [r.task_id for r in joins.split_by_keys(outbox, keys, "task_id")[1].collect()] == ["new"]


def test_stale_jobs_and_their_targets(spark):
    jobs = spark.createDataFrame(
        [
            (1, "CANCELLATION_REQUESTED", ago(minutes=1), ago(minutes=5), 11),
            (2, "STARTED", ago(minutes=1), ago(minutes=5), 12),
            (3, "STARTED", NOW + dt.timedelta(hours=1), ago(days=9), 13),
            (4, "PENDING", None, ago(days=2), 14),
            (5, "STARTED", None, ago(hours=1), 15),
            (6, "SUCCESS", ago(days=2), ago(days=2), 16),
        ],
        "task_id int, status string, lease_expires_at timestamp, updated_at timestamp, target int",
    )
    stale = stale_condition(F.lit(NOW), F.lit(ago(hours=24)))
    ended = joins.settle_jobs(jobs, stale, message="lost")
    found = {r.task_id: (r.status, r.error_message) for r in ended.collect()}
    assert found == {
        1: ("CANCELLED", None), 2: ("FAILURE", "lost"), 3: ("STARTED", None),
        4: ("FAILURE", "lost"), 5: ("STARTED", None), 6: ("SUCCESS", None),
    }
    targets = spark.createDataFrame(
        [(11, "processing"), (12, "processing"), (13, "processing"), (14, "completed")],
        "target int, status string",
    )
    outcome = ended.filter("reconciled").select(
        "target", (F.col("status") == "CANCELLED").alias("cancelled")
    )
    moved = joins.follow_jobs(targets, outcome, "target", final=("completed", "undone"))
    assert {r.target: r.status for r in moved.collect()} == {
        11: "cancelled", 12: "failed", 13: "processing", 14: "completed"
    }


def test_reconcile(spark):
    reports = spark.createDataFrame(
        [(1, "queued", ago(days=3), "f1"), (2, "queued", ago(days=3), "f2"),
         (3, "queued", None, "f3"), (4, "completed", ago(days=3), "f4")],
        "id int, status string, updated_at timestamp, file_path string",
    )
    active = spark.createDataFrame([(2,), (2,)], "id int")
    found = joins.reconcile(
        reports, active, "id", F.lit(ago(days=1)), {"queued": "failed"}, "lost", clear=["file_path"]
    )
    got = {r.id: (r.status, r.error_message, r.file_path) for r in found.collect()}
    assert got == {
        1: ("failed", "lost", None), 2: ("queued", None, "f2"),
        3: ("queued", None, "f3"), 4: ("completed", None, "f4"),
    }


def test_active_rows(spark):
    df = spark.createDataFrame(
        [("ready", None), ("ready", NOW), ("failed", None)], "status string, deleted_at timestamp"
    )
    assert active_rows(df, ["ready", "profiled"]).count() == 1


def test_pages(spark):
    df = spark.range(250)
    assert [r.id for r in ranking.page(df, [F.col("id")], 3, 100).collect()] == list(range(200, 250))
    for number, size in [(0, 10), (1, 0), (1, 101)]:
        with pytest.raises(ValueError, match="Pages"):
            ranking.page(df, [F.col("id")], number, size)


def test_latest_per_key_with_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, "x"), ("b", None, "old"), (None, 1, "n")], "k string, t int, v string"
    )
    found = ranking.latest_per_key(df, ["k"], ["t"])
    assert found.columns == ["k", "t", "v"]
    assert {tuple(r) for r in found.collect()} == {("a", 2, "x"), ("b", None, "old"), (None, 1, "n")}


def test_storage(spark):
    a = spark.createDataFrame([(1, "p", "q"), (1, "p", None), (2, "", "z")], "o int, x string, y string")
    references = rollups.distinct_references([(a, "o", ["x", "y"])])
    assert {tuple(r) for r in references.collect()} == {(1, "p"), (1, "q"), (2, "z")}
    files = spark.createDataFrame([("p", 10), ("z", 5)], "path string, size bigint")
    used = rollups.storage_per_owner(references, files, quota=8)
    assert {(r.owner_id, r.files, r.used_bytes, r.over_quota) for r in used.collect()} == {
        (1, 2, 10, True), (2, 1, 5, False)
    }


def test_settled_jobs_keep_their_messages(spark):
    rows = [(1, "RUNNING", "disk full", False), (2, "RUNNING", "old", True),
            (3, "CANCELLATION_REQUESTED", "kept", True), (4, None, None, True), (5, "x", "y", None)]
    jobs = spark.createDataFrame(rows, "id int, status string, error_message string, s boolean")
    got = joins.settle_jobs(jobs, F.col("s"), message="timed out").drop("s").collect()
    assert [tuple(r[:3]) + (r["reconciled"],) for r in got] == [
        (1, "RUNNING", "disk full", False), (2, "FAILURE", "timed out", True),
        (3, "CANCELLED", "kept", True), (4, "FAILURE", "timed out", True), (5, "x", "y", False),
    ]


def test_a_row_without_a_status_is_not_stuck(spark):
    rows = [(1, None, 5, "a"), (2, "working", 5, "b"), (3, "working", 99, "c")]
    entities = spark.createDataFrame(rows, "id int, status string, updated_at int, lease string")
    active = spark.createDataFrame([], "id int")
    got = joins.reconcile(entities, active, "id", F.lit(50), {"working": "ready"}, clear=["lease"])
    state = sorted((r["id"], r["status"], r["reconciled"], r["lease"]) for r in got.collect())
    assert state == [(1, None, False, "a"), (2, "ready", True, None), (3, "working", False, "c")]


def test_live_references(spark):
    datasets = spark.createDataFrame(
        [("a", "ready", None), ("b", "cancelled", None), ("c", "ready", 1), ("d", None, None), ("", "ready", None)],
        "stored_path string, status string, deleted_at int",
    )
    changes = spark.createDataFrame(
        [("i1", "o1", "completed", "t1"), ("i2", "o2", "pending", "t2"), ("i3", "o3", "pending", "t3"),
         (None, "o4", "undone", None), ("i1", "o5", "failed", "t2")],
        "input_path string, output_path string, status string, task_id string",
    )
    reports = spark.createDataFrame([("r1", "completed"), ("r2", "failed")], "file_path string, status string")
    active = spark.createDataFrame([("t2",)], "task_id string")
    found = joins.live_references(datasets, changes, reports, active).collect()
    assert sorted(r["path"] for r in found) == ["a", "d", "i1", "i2", "i3", "o1", "o2", "o4", "r1"]


def test_outcomes_by_kind_of_job(spark):
    datasets = spark.createDataFrame(
        [(1, "queued", 1, None), (2, "queued", 1, None), (3, "profiling", 1, None), (4, "ready", 1, None),
         (5, "transforming", 2, None), (6, "transforming", 3, None), (7, "transforming", 2, None), (8, "x", 1, 5)],
        "id int, status string, version int, deleted_at int",
    )
    ended = spark.createDataFrame(
        [("import", 1, None, True), ("import", 2, None, False), ("profile", 3, None, False),
         ("profile", 4, None, True), ("transformation", 5, 50, False), ("transformation", 6, 60, False),
         ("transformation", 7, 70, True)],
        "kind string, dataset_id int, change_id int, cancelled boolean",
    )
    changes = spark.createDataFrame(
        [(50, "processing", 2, "m"), (60, "processing", 2, None), (70, "completed", 2, "n"), (80, None, 1, "k")],
        "id int, status string, expected_version int, error_message string",
    )
    got = joins.settle_datasets(datasets, ended, changes, F.lit(9)).orderBy("id").collect()
    assert [(r["status"], r["deleted_at"]) for r in got] == [
        ("cancelled", 9), ("failed", None), ("ready", None), ("ready", None),
        ("ready", None), ("transforming", None), ("transforming", None), ("x", 5),
    ]
    by_change = ended.filter("change_id IS NOT NULL").withColumnRenamed("change_id", "id")
    moved = joins.settle_outcomes(changes, by_change, "id", ("completed", "undone"), "timed out", ("expected_version",))
    assert [tuple(r) for r in moved.orderBy("id").collect()] == [
        (50, "failed", None, "timed out"), (60, "failed", None, "timed out"),
        (70, "completed", 2, "n"), (80, None, 1, "k"),
    ]


def test_ranked_pages_read_few_pieces(spark, tmp_path):
    from quillgrid.operators import ranking

    df = spark.range(2_000).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    ranking.write_ranked(df, order, str(tmp_path / "t"), piece_rows=90)
    for number, size in ((1, 100), (2, 7), (199, 10), (200, 10), (201, 10), (20, 100), (21, 100)):
        got = ranking.ranked_page(spark, str(tmp_path / "t"), order, number, size).collect()
        assert got == ranking.page(df, order, number, size).collect()
    plan = ranking.ranked_page(spark, str(tmp_path / "t"), order, 150, 10)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(_piece" in plan.split("PartitionFilters")[1]
    with pytest.raises(ValueError):
        ranking.ranked_page(spark, str(tmp_path / "t"), order, 0, 10)


def test_small_ranked_pieces_share_a_folder(spark, tmp_path, monkeypatch):
    """Folders, one per task, grow with the rows and not with the number of pieces."""
    from quillgrid.operators import ranking

    df = spark.range(2_000).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    for label, folder_rows, most in (("one", 250_000, 1), ("some", 300, 7)):
        monkeypatch.setattr(ranking, "FOLDER_ROWS", folder_rows, raising=False)
        path = str(tmp_path / label)
        ranking.write_ranked(df, order, path, piece_rows=7)
        files = list((tmp_path / label / "rows").rglob("*.parquet"))
        assert len(files) == len({f.parent for f in files}) <= most
        index = spark.read.parquet(f"{path}/index").orderBy("_piece").collect()
        assert len(index) >= 2_000 / 7 and max(r["rows"] for r in index) == 7
        assert [r["before"] for r in index] == [sum(q["rows"] for q in index[:i]) for i in range(len(index))]
        border = next((i for i in range(1, len(index)) if index[i]["_pieces"] > index[0]["_pieces"]), 50)
        for number, size in ((1, 7), (index[border]["before"] // 20 + 1, 20), (2_000, 1), (41, 50)):
            page = ranking.ranked_page(spark, path, order, number, size)
            assert page.collect() == ranking.page(df, order, number, size).collect()
        plan = ranking.ranked_page(spark, path, order, 3, 10)._jdf.queryExecution().executedPlan().toString()
        assert "(_piece," in plan.split("PushedFilters")[1]
