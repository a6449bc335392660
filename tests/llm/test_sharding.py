import zlib

import pytest

from quillgrid.llm.sharding import assign_shards, jump_shard


def jump(key, buckets):
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("buckets", [1, 2, 24, 100])
def test_the_published_function(spark, buckets):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), *range(10**6, 10**6 + 300)]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    got = frame.select("key", jump_shard(frame["key"], buckets).alias("s")).collect()
    assert all(r["s"] == jump(r["key"], buckets) for r in got)


def test_rows_are_numbered_without_gaps_and_move_only_to_the_new_shard(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "repeat('é', CAST(id % 7 AS INT)) AS text")
    rows = assign_shards(frame, "doc_id", "text", 24).collect()
    assert len(rows) == 3000
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
        text = ("é" * (r["doc_id"] % 7)).encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    assert set(by_shard) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 60 < sum(r["grown_shard"] == 24 for r in rows) < 190


def test_missing_empty_tied_and_repeated_rows(spark, awkward):
    frame = awkward([None, "", "a", "a" * 100_000, "a"])
    frame = frame.union(frame).union(frame.limit(1))
    rows = assign_shards(frame, "doc_id", "text", 3).collect()
    assert len(rows) == 11
    assert {r["shard"] for r in rows if r["doc_id"] is None} <= {0, 1, 2}
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(
            range(sum(r["shard"] == shard for r in rows))
        )
    assert {r["size"] for r in rows} == {8, 9, 100_008}
    assert assign_shards(frame.limit(0), "doc_id", "text", 3).count() == 0


def test_a_key_with_most_rows(spark):
    frame = spark.range(2000).selectExpr("IF(id < 1500, 7, id) AS doc_id", "'t' AS text")
    rows = assign_shards(frame, "doc_id", "text", 4).collect()
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
