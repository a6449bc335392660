import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.operators import rules
from quillgrid.session import work_folder
from quillgrid.streaming import anchored, requests, windows
from quillgrid.streaming.ordered import stream_session

SECOND = 1_000_000


def counted(instants, length):
    """The window start of every instant, by walking them in order."""
    starts, end = [], None
    for t in sorted(instants):
        if end is None or t >= end:
            start, end = t, t + length
        starts.append((t, start))
    return starts


def keys_of_every_kind(seed):
    rng = np.random.default_rng(seed)
    length = 10 * SECOND
    keys = {
        "even": list(range(0, 4000 * SECOND, SECOND)),
        "exact": list(range(0, 3000 * SECOND, length)),
        "just_short": list(range(0, 3000 * SECOND, length - 1)),
        "just_over": list(range(0, 3000 * SECOND, length + 1)),
        "before_1970": [-5 * length - 3, -length, -1, 0, length - 1],
        "single": [17],
        "same": [5 * SECOND] * 40,
        "far": [0, 2 * length, 10**15, 10**15 + 1, 10**15 + length],
        "slow_drift": list(np.cumsum(np.full(900, length // 3 + 1)).tolist()),
    }
    for i in range(25):
        n = int(rng.integers(1, 400))
        spread = int(rng.integers(1, 20_000)) * SECOND
        keys[f"random{i}"] = rng.integers(-spread, spread, n).tolist()
    for i in range(5):
        keys[f"bursts{i}"] = (
            rng.integers(0, 40, 200) * 13 * SECOND + rng.integers(0, SECOND, 200)
        ).tolist()
    return keys


@pytest.mark.parametrize("piece_rows", [30, 3_000, 1_000_000])
def test_anchored_windows(spark, piece_rows):
    keys = keys_of_every_kind(piece_rows)
    if piece_rows == 30:  # more pieces would take minutes
        keys = {k: [t for t in ts if t < 200 * SECOND] for k, ts in keys.items() if not k.startswith("random")}
    rows = [(k, int(t)) for k, ts in keys.items() for t in ts]
    rows += [(None, 5), ("even", None)]
    events = spark.createDataFrame(rows, "k string, t bigint").select(
        "k", F.timestamp_micros("t").alias("ts")
    )
    events = events.repartition(3)
    got, attempts = {}, {}
    for r in windows.anchored_windows(events, "k", "ts", 10, piece_rows).collect():
        got.setdefault(r.k, []).extend([(r.instant, r.window_start)] * r.n)
    numbered = windows.anchored_attempts(events.withColumn("id", F.rand(1)), "k", "ts", "id", 10, 2, piece_rows)
    for r in numbered.collect():
        attempts.setdefault(r.k, []).append((r.instant, r.window_start, r.attempt))
    for k, ts in keys.items():
        expected = counted([int(t) for t in ts], 10 * SECOND)
        assert sorted(got[k]) == expected, k
        numbers, before = [], None
        for t, start in expected:
            numbers.append((t, start, numbers[-1][2] + 1 if start == before else 1))
            before = start
        assert sorted(attempts[k]) == numbers, k


def test_one_key_with_windows_longer_than_pieces(spark):
    """No task holds more rows than a piece has, whatever a key or a window holds."""
    rng = np.random.default_rng(8)
    instants = np.sort(rng.integers(0, 40 * 86_400, 1_500)) * SECOND
    events = spark.createDataFrame([(1, int(t)) for t in instants], "k int, t bigint").select(
        "k", F.timestamp_micros("t").alias("ts")
    )
    for seconds in (86_400, 90 * 86_400):
        found = windows.anchored_counts(events, "k", "ts", seconds, 3, piece_rows=100)
        expected = {}
        for _, start in counted(instants.tolist(), seconds * SECOND):
            expected[start] = expected.get(start, 0) + 1
        assert {r.window_start: r.attempts for r in found.collect()} == expected
    placed = windows.anchored_windows(events, "k", "ts", 86_400, piece_rows=100)
    assert placed.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 250


def test_keys_of_any_type(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(-1.5, i % 3, base + dt.timedelta(seconds=7 * i)) for i in range(40)] + [(0.0, 5, base)]
    events = spark.createDataFrame(rows, "f double, i int, ts timestamp")
    for key in (F.col("f"), F.struct("f", "i"), F.col("i").cast("decimal(9,2)"), F.col("ts")):
        keyed = events.withColumn("k", key)
        few, many = (
            sorted((str(r.k), r.window_start, r.attempts) for r in windows.anchored_counts(keyed, "k", "ts", 60, 3, n).collect())
            for n in (100, 4)
        )
        assert few == many and sum(r[2] for r in few) == 41


@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(1, 25), st.integers(-5, 90))
def test_step_functions(instants, length, end):
    t = np.unique(instants)
    entry, before, exits = anchored.steps_of(t, length)
    assert (np.diff(exits) != 0).all() and before[0] == anchored.NEVER
    end = min(end, int(t[0]) + length - 1)
    k = int(np.searchsorted(entry, end))
    walked = end
    for x in t.tolist():
        walked = x + length if x >= walked else walked
    assert (int(exits[k]) if k < len(entry) else end) == walked


def test_attempts_and_limit(spark, rows):
    base = dt.datetime(2024, 1, 1)
    offsets = [0, 0, 10, 59, 60, 61, 200]
    events = spark.createDataFrame(
        [(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate(offsets)],
        "id int, k string, ts timestamp_ntz",
    )
    found = windows.anchored_attempts(events, "k", "ts", "id", 60, limit=3).orderBy("id")
    assert [r.attempt for r in found.collect()] == [1, 2, 3, 4, 1, 2, 1]
    assert [r.over_limit for r in found.collect()] == [False, False, False, True] + [False] * 3
    sums = windows.anchored_counts(events, "k", "ts", 60, limit=3).orderBy("window_start")
    assert [(r.attempts, r.rejected) for r in sums.collect()] == [(4, 1), (2, 0), (1, 0)]


def written(spark, stream):
    out, checkpoint = work_folder(spark, "stream"), work_folder(spark, "checkpoint")
    started = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    started.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@pytest.fixture
def split_events(spark):
    """The events in time order, in several files that arrive one per micro-batch."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = work_folder(spark, "events")
    days = [f"2024-01-{d:02d}" for d in range(1, 32, 6)] + ["2024-02-01"]
    for low, high in zip(days, days[1:]):
        part = events.filter((F.col("ts") >= low) & (F.col("ts") < high))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return events, stream


def in_files(spark, rows, folder, size):
    """Rows (tuples with the time in seconds at `ts`) as a stream of files in the given order."""
    for i in range(0, len(rows), size):
        frame = spark.createDataFrame(rows[i : i + size], "k string, id bigint, s bigint, p int")
        frame.select("k", "id", F.timestamp_seconds("s").alias("ts"), "p").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def streamed(stream):
    return [r for r in written(stream.sparkSession, stream).collect() if r["k"] != "end"]


def late_rows(seed, keys, count, spread, lateness):
    """Rows by time, each up to `lateness` seconds late, and one that ends the stream."""
    rng = np.random.default_rng(seed)
    times = rng.integers(1, spread, count)
    order = np.argsort(times + rng.integers(0, lateness, count), kind="stable")
    rows = [(keys[int(rng.integers(len(keys)))], int(i), int(times[i]), int(rng.integers(2))) for i in order]
    return [*rows, ("end", -1, spread * 10, 0)]


@pytest.mark.parametrize("keys, bucket", [(["hot"], 7), (["a", "b", "c"], 500)])
def test_streamed_attempts_equal_the_batch(spark, tmp_path, keys, bucket):
    """Windows end in many batches, while others wait for late events."""
    rows = late_rows(len(keys), keys, 300, 6_000, 200)
    stream = in_files(spark, rows, str(tmp_path / "in"), 60)
    got = streamed(windows.stream_attempts(stream, "k", "ts", 100, limit=2, delay="250 seconds", bucket_seconds=bucket))
    events = spark.createDataFrame(rows[:-1], "k string, id bigint, s bigint, p int").withColumn("ts", F.timestamp_seconds("s"))
    want = windows.anchored_attempts(events, "k", "ts", "id", 100, limit=2)
    columns = ["k", "instant", "window_start", "attempt", "over_limit"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(map(tuple, want.select(columns).collect()))


def test_state_ends_with_the_window(spark, tmp_path):
    rows = [("a", 1, 10, 0), ("a", 2, 15, 0), ("b", 3, 5_000, 0), ("a", 4, 9_000, 0), ("end", 5, 90_000, 0), ("end", 6, 99_000, 0)]
    stream = windows.stream_attempts(in_files(spark, rows, str(tmp_path / "in"), 1), "k", "ts", 60, 2, "1 second", 30)
    checkpoint = work_folder(spark, "checkpoint")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(work_folder(spark, "out"))
    query.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) >= 2 and held[-1] <= max(held)
    out = stream.sparkSession.read.format("state-metadata").load(checkpoint)
    assert out.count()


def test_streamed_outcomes_equal_the_batch(spark, tmp_path):
    rows = late_rows(9, ["x", "y", "z", "w"], 200, 5_000, 300)
    events = spark.createDataFrame(rows[:-1], "k string, id bigint, s bigint, p int").withColumn("ts", F.timestamp_seconds("s"))
    stream = in_files(spark, rows, str(tmp_path / "in"), 40)
    got = streamed(requests.request_outcomes_stream(stream, ["k"], ["p"], "ts", "id", "400 seconds", 50))
    want = rules.request_outcomes(events, ["k"], ["p"], ["ts", "id"]).collect()
    assert {r.id: r.outcome for r in got} == {r.id: r.outcome for r in want} and len(got) == 200
    assert {r.outcome for r in got} == {"accepted", "repeated", "conflict"}


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    rows = [("a", 1, 1_000, 1), ("a", 2, 1_050, 2), ("a", 3, 1_100, 2), ("a", 4, 1_130, 1), ("end", 5, 9_000, 0)]
    stream = in_files(spark, rows, str(tmp_path / "in"), 2)
    got = streamed(requests.request_outcomes_stream(stream, ["k"], ["p"], "ts", "id", "60 seconds", 10, remember_seconds=100))
    assert {r.id: r.outcome for r in got} == {1: "accepted", 2: "conflict", 3: "accepted", 4: "conflict"}


def test_streamed_tumbling_counts_equal_the_batch(spark, split_events):
    events, stream = split_events
    got = written(spark, windows.tumbling_counts(stream, "user_id", "ts", 86400, 2, "1 hour"))
    want = windows.tumbling_counts(events, "user_id", "ts", 86400, 2)
    last = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=25)
    closed = want.filter(F.col("window_start") <= F.lit(last))
    assert sorted(map(tuple, got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).collect())) == sorted(map(tuple, closed.collect()))


def test_streamed_requests_keep_the_first(spark, split_events):
    events, stream = split_events
    got = written(
        spark, requests.first_requests_stream(stream, ["user_id", "event_type"], "ts", "60 days")
    )
    keys = [(r.user_id, r.event_type) for r in got.collect()]
    assert len(keys) == len(set(keys)) == events.select("user_id", "event_type").distinct().count()
