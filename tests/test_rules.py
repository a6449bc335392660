import json

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import rules


def test_rules_pass_on_missing_values(spark, rows):
    df = spark.createDataFrame([(1, "ready", 50), (2, "odd", 101), (3, None, None)], "id int, status string, p int")
    checks = {
        "status": F.col("status").isin("ready", "failed"),
        "progress": F.col("p").between(0, 100),
    }
    assert rows(rules.rule_violations(df, checks)) == [(2, "odd", 101, ["status", "progress"])]
    assert sorted(rows(rules.rule_counts(df, checks))) == [("progress", 1), ("status", 1)]


def test_unique_keys(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None)], "x int, y string")
    assert rows(rules.duplicate_keys(df, ["x", "y"])) == [(1, "a", 2)]


def test_structure(spark, rows):
    with pytest.raises(ValueError, match="256 letters"):
        rules.check_structure(spark.range(1).toDF("x" * 257))
    with pytest.raises(ValueError, match="2 are the most"):
        rules.check_structure(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), 2)
    assert rows(rules.shape(spark.range(5), max_rows=4)) == [(5, 1, True)]


def test_payload_size_counts_bytes(spark, rows):
    df = spark.createDataFrame([("é", None)], "v string, w int")
    sized = df.select(rules.payload_bytes("v", "w"))
    assert rows(sized) == [(len('{"v":"é","w":null}'.encode()),)]
    assert rules.oversized_payloads(df, ["v"], 5).count() == 1
    texts = ["é", "日本", "🙂x\n\"", "\x7f\x01", "plain", None]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    sizes = rows(frame.select(rules.payload_bytes("v", escaped=True)))
    assert sizes == [(len(json.dumps({"v": t}, separators=(",", ":"))),) for t in texts]


def test_repeated_requests(spark):
    df = spark.createDataFrame(
        [(1, "k", "drop", 1), (2, "k", "drop", 1), (3, "k", "fill", 1), (4, "j", None, 2), (5, "j", None, 2)],
        "id int, key string, op string, v int",
    )
    found = {r.key: r for r in rules.first_requests(df, ["key"], ["op", "v"], ["id"]).collect()}
    assert (found["k"].id, found["k"].op, found["k"].requests, found["k"].conflict) == (1, "drop", 3, True)
    assert (found["j"].id, found["j"].requests, found["j"].conflict) == (4, 2, False)
    outcomes = rules.request_outcomes(df, ["key"], ["op", "v"], ["id"]).orderBy("id").collect()
    assert [r.outcome for r in outcomes] == ["accepted", "repeated", "conflict", "accepted", "repeated"]
