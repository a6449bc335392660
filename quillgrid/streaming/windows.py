"""Attempt counting per key in time windows, in batch and as a stream.

How anchored windows are found over any number of events per key is in `anchored.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import col, type_of
from quillgrid.streaming.anchored import PIECE_ROWS, distinct_instants, in_windows
from quillgrid.streaming.ordered import Attempts, in_event_time

# The default window length and how many attempts it allows.
WINDOW_SECONDS = 60
ATTEMPT_LIMIT = 10

MICROS = 1_000_000


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970, without passing through the session's time zone."""
    if isinstance(type_of(df, ts), T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, col(ts))
    return F.unix_micros(col(ts))


def tumbling_counts(
    events: DataFrame,
    key: str,
    ts: str,
    seconds: int = WINDOW_SECONDS,
    limit: int = ATTEMPT_LIMIT,
    watermark: str | None = None,
) -> DataFrame:
    """Attempts per key in clock-aligned windows, and whether they exceed the limit.

    On a stream pass a watermark: windows are then emitted once and later events dropped.
    """
    if isinstance(type_of(events, ts), T.TimestampNTZType) and watermark:
        events = events.withColumn(ts, col(ts).cast("timestamp"))
    if watermark:
        events = events.withWatermark(ts, watermark)
    counted = events.groupBy(F.window(col(ts), f"{seconds} seconds"), col(key)).agg(
        F.count(F.lit(1)).alias("attempts")
    )
    return counted.select(
        col(key),
        F.col("window.start").alias("window_start"),
        "attempts",
        (F.col("attempts") > limit).alias("over_limit"),
    )


def anchored_windows(
    events: DataFrame, key: str, ts: str, seconds: int = WINDOW_SECONDS, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """`key, instant, n, window_start`: the window of every instant of a key.

    Times are microseconds since 1970 and `n` counts the events at the instant. Events without a
    key or a time are left out. Counting the events and finding the windows that are open between
    pieces runs at once; the result is lazy.
    """
    instants = distinct_instants(col(key), micros(events, ts), events)
    upper = events.select(col(key), col(ts)).na.drop().count()
    placed = in_windows(instants, [], seconds * MICROS, upper, piece_rows, running=False)
    return placed.withColumnRenamed("key", key)


def anchored_counts(
    events: DataFrame,
    key: str,
    ts: str,
    seconds: int = WINDOW_SECONDS,
    limit: int = ATTEMPT_LIMIT,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Attempts per key and anchored window, and how many of them exceed the limit."""
    windows = anchored_windows(events, key, ts, seconds, piece_rows)
    counted = windows.groupBy(col(key), "window_start").agg(F.sum("n").alias("attempts"))
    return counted.withColumn("rejected", F.greatest(F.col("attempts") - limit, F.lit(0)))


def anchored_attempts(
    events: DataFrame,
    key: str,
    ts: str,
    tie: str,
    seconds: int = WINDOW_SECONDS,
    limit: int = ATTEMPT_LIMIT,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Every event with its running number in its window and whether that exceeds the limit.

    Events of one instant are numbered in the order of `tie`. A window, or an instant, with any
    share of all events is numbered piece by piece.
    """
    rows = events.select(
        col(key).alias("key"), micros(events, ts).alias("instant"), F.lit(1).cast("bigint").alias("n"),
        col(tie).alias("tie"), F.struct(*[col(c) for c in events.columns]).alias("row"),
    ).na.drop(subset=["key", "instant"])
    upper = rows.select("key", "instant").count()
    placed = in_windows(rows, ["tie"], seconds * MICROS, upper, piece_rows, running=True)
    attempt = F.col("before") + 1
    return placed.select(
        "row.*", "instant", "window_start", attempt.alias("attempt"), (attempt > limit).alias("over_limit")
    )


def stream_attempts(
    events: DataFrame,
    key: str,
    ts: str,
    seconds: int = WINDOW_SECONDS,
    limit: int = ATTEMPT_LIMIT,
    delay: str = "1 hour",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """The running attempt number of every streamed event, in the order of event times.

    Events may arrive in any order up to `delay`; those behind the watermark are dropped, as in
    every stateful stream. An event is counted once the watermark has passed its bucket of
    `bucket_seconds` (by default an eighth of the window, a second at least), so the result is that
    of the batch form for all such events. A key's state is its waiting events, bucket by bucket, and the open window;
    it is removed once the window has ended and nothing waits. See `ordered` for the state store.
    """
    bucket = max(1, bucket_seconds if bucket_seconds is not None else seconds // 8) * MICROS
    return in_event_time(
        events, [key], micros(events, ts), col(ts), [], delay, Attempts(seconds * MICROS, limit, bucket),
        "instant bigint, window_start bigint, attempt bigint, over_limit boolean",
    )
