import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillgrid.plans import lineage, versions
from quillgrid.session import work_folder
from quillgrid.sources import readers

PEOPLE = [("Ada", 30, 100), ("Ben", 40, 200), ("Ben", 40, 200)]
DEDUPE = {"operation": "drop_duplicates"}


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, age int, salary int")


def test_preview(people, rows):
    assert rows(lineage.preview_counts(people, "drop_duplicates")) == [
        ("before", 3, 3, 0), ("after", 2, 3, 0)
    ]
    order = [F.col("name")]
    sample = lineage.preview_sample(people, "drop_columns", {"columns": ["age"]}, order)
    assert rows(sample) == [("Ada", 100), ("Ben", 200), ("Ben", 200)]


def test_apply_with_lineage(people):
    steps = [DEDUPE, {"operation": "drop_columns", "parameters": {"columns": ["age"]}}]
    result, log = lineage.apply_with_lineage(people, steps, start_version=4)
    assert result.count() == 2 and result.columns == ["name", "salary"]
    found = log.orderBy("step").collect()
    assert [(r.expected_version, r.before_rows, r.after_rows) for r in found] == [(4, 3, 2), (5, 2, 2)]
    assert [(r.before_columns, r.after_columns) for r in found] == [(3, 3), (3, 2)]
    assert found[1].parameters == '{"columns": ["age"]}'


def stored(log):
    return log.select(
        F.lit(1).alias("dataset_id"),
        F.lit(9).alias("user_id"),
        F.col("step").alias("id"),
        "expected_version",
        "status",
        F.lit(None).cast("timestamp").alias("undone_at"),
        F.timestamp_seconds("step").alias("created_at"),
        "before_rows",
        "after_rows",
    )


def test_write_undo_export(spark, people):
    root, out = work_folder(spark, "versions"), work_folder(spark, "export")
    log = stored(lineage.apply_and_write(people, [DEDUPE], root))
    assert lineage.active_versions(log).first().active_version == 2
    assert lineage.read_version(spark, root, 1).count() == 3
    assert lineage.read_version(spark, root, 2).count() == 2
    assert lineage.history(log).first().row_delta == 1
    undone = lineage.undo_one(log, 1, 9, F.now())
    assert undone.first().status == "undone" and undone.first().undone_at is not None
    assert lineage.export_active(spark, root, undone, 1, out, "csv") == 1
    assert readers.read_csv(spark, out).count() == 3
    with pytest.raises(ValueError, match="Nothing to undo"):
        lineage.undo_one(undone, 1, 9, F.now())
    with pytest.raises(Exception, match="already exists"):
        lineage.write_version(people, root, 1)


def test_undo_needs_the_active_version(spark):
    day = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [
            (1, 9, 1, 1, "completed", None, day),
            (1, 8, 2, 2, "completed", None, day + dt.timedelta(1)),
            (2, 9, 3, 1, "failed", None, day),
        ],
        "dataset_id int, user_id int, id int, expected_version int, status string,"
        " undone_at timestamp, created_at timestamp",
    )
    with pytest.raises(ValueError, match="active version"):
        lineage.undo_one(log, 1, 9, F.now())
    after = {r.id: r.status for r in lineage.undo_latest(log, F.now()).collect()}
    assert after == {1: "completed", 2: "undone", 3: "failed"}
    versions = {r.dataset_id: r.active_version for r in lineage.active_versions(log).collect()}
    assert versions == {1: 3, 2: 1}


def test_too_wide_result_is_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="256 letters"):
        lineage.preview_counts(df, "rename_columns", {"mapping": {"a": "x" * 257}})


FILL = {"operation": "fill_nulls", "parameters": {"values": {"name": "?"}}}


def test_of_two_concurrent_changes_one_commits(spark, people):
    root = work_folder(spark, "versions")
    seen = versions.create(people, root, "a")

    def attempt(user):
        try:
            return versions.change(spark, root, DEDUPE, user, expected_version=1, based_on=seen)
        except versions.VersionConflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        done = [s for s in pool.map(attempt, "abcdef") if s is not None]
    assert len(done) == 1
    assert versions.state(spark, root) == done[0]
    log = versions.read_log(spark, root).collect()
    assert sorted(r.id for r in log) == [0, 1]
    assert not [f for f in os.listdir(f"{root}/log") if not f.endswith(".json")]
    with pytest.raises(versions.VersionConflict, match="Version 2 is active"):
        versions.change(spark, root, DEDUPE, "a", expected_version=1)


def test_change_undo_change(spark, people):
    root = work_folder(spark, "versions")
    versions.create(people, root, "a")
    with pytest.raises(Exception, match="committed first"):
        versions.create(people, root, "b")
    for _ in range(2):
        two = versions.change(spark, root, DEDUPE, "a")
        assert (two.version, two.rows, versions.read_active(spark, root).count()) == (2, 2, 2)
        with pytest.raises(ValueError, match="another user"):
            versions.undo(spark, root, "b")
        assert versions.undo(spark, root, "a").version == 1
        assert versions.read_active(spark, root).count() == 3
    with pytest.raises(ValueError, match="Nothing to undo"):
        versions.undo(spark, root, "a")
    versions.apply_steps(spark, root, [FILL, DEDUPE], "b")
    rows = versions.lineage(spark, root).orderBy("id").collect()
    assert [(r.expected_version, r.status) for r in rows] == [(1, "undone"), (1, "undone"), (1, "completed"), (2, "completed")]
    assert len({r.path for r in rows}) == 4 and versions.state(spark, root).version == 3
    log = versions.lineage(spark, root).withColumn("dataset_id", F.lit(1))
    assert lineage.active_versions(log).first().active_version == 3
    assert lineage.read_version(spark, root, 3).count() == 2


def test_a_change_reads_its_input_once(spark, people):
    """Rows and missing cells are counted while the version is written."""
    root = work_folder(spark, "versions")
    gaps = people.withColumn("age", F.when(F.col("name") == "Ada", F.col("age")))
    assert versions.create(gaps, root).missing == 2
    group = "one-change"
    spark.sparkContext.setJobGroup(group, group)
    seen = versions.state(spark, root)
    spark.sparkContext.setJobGroup("write", "write")
    done = versions.change(spark, root, {"operation": "fill_nulls", "parameters": {"values": {"age": 1}}}, based_on=seen)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("write")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (done.rows, done.missing, done.columns) == (3, 0, 3)
    assert len(jobs) <= 3  # the footer, the write, the time of the commit
