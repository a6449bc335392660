"""Time window queries, in batch and as streams run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.session import work_folder
from quillgrid.streaming import requests as streamed
from quillgrid.streaming import windows
from quillgrid.streaming.ordered import stream_session
from quillgrid.suite import query, table

DAY = 86_400


def anchored_sql(seconds: int, source: str = "events") -> str:
    length = seconds * 1_000_000
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM {source}),
        w AS (SELECT user_id, min(t) AS s FROM e GROUP BY user_id
              UNION ALL
              SELECT e.user_id, min(e.t) FROM w JOIN e
                     ON e.user_id = w.user_id AND e.t >= w.s + {length} GROUP BY e.user_id, w.s),
        p AS (SELECT e.*, w.s FROM e JOIN w ON e.user_id = w.user_id
              AND e.t >= w.s AND e.t < w.s + {length})"""


@query(
    "window_anchored_counts",
    anchored_sql(DAY)
    + """ SELECT user_id, s AS window_start, count(*) AS attempts,
                 greatest(count(*) - 4, 0) AS rejected FROM p GROUP BY ALL""",
)
def window_anchored_counts(spark, sf):
    return windows.anchored_counts(table(spark, sf, "events"), "user_id", "ts", DAY, limit=4)


ATTEMPTS = """ SELECT event_id, s AS window_start,
    row_number() OVER (PARTITION BY user_id, s ORDER BY t, event_id) AS attempt,
    row_number() OVER (PARTITION BY user_id, s ORDER BY t, event_id) > 2 AS over_limit FROM p"""


@query("window_anchored_attempts", anchored_sql(3600 * 6) + ATTEMPTS)
def window_anchored_attempts(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return windows.anchored_attempts(events, "user_id", "ts", "event_id", 3600 * 6, limit=2).select(
        "event_id", "window_start", "attempt", "over_limit"
    )


@query(
    "window_anchored_one_key",
    anchored_sql(60, "(SELECT 1 AS user_id, event_id, ts FROM events)")
    + """ SELECT user_id, s AS window_start, count(*) AS attempts,
                 greatest(count(*) - 10, 0) AS rejected FROM p GROUP BY ALL""",
)
def window_anchored_one_key(spark, sf):
    """All events belong to one key, in windows of a minute."""
    events = table(spark, sf, "events").withColumn("user_id", F.lit(1))
    return windows.anchored_counts(events, "user_id", "ts")


@query(
    "window_tumbling_counts",
    """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS attempts,
              count(*) > 4 AS over_limit FROM events GROUP BY ALL""",
)
def window_tumbling_counts(spark, sf):
    return windows.tumbling_counts(table(spark, sf, "events"), "user_id", "ts", DAY, limit=4)


def run_stream(spark, stream, mode="append"):
    """Run a stream over what is there now and read back the files it wrote."""
    out, checkpoint = work_folder(spark, "stream"), work_folder(spark, "checkpoint")
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    started.format("parquet").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# The key of an event that only ends a stream.
CLOSING = -1


def in_order_of_time(spark, sf, columns, delay_days=2):
    """The events as a stream of seven files: six spans of time that overlap by half a day, and an
    event that moves the watermark past all others."""
    events = table(spark, sf, "events").select(*columns)
    # A row's own shift lets it arrive with the span before or after its own.
    late = F.col("ts") + F.make_dt_interval(hours=F.pmod(F.xxhash64("ts", "user_id"), F.lit(24)).cast("int") - 12)
    first, last = table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    span = (last - first) / 6
    folder = work_folder(spark, "events")
    for i in range(6):
        low = late >= F.lit(first + i * span) if i else F.lit(True)
        high = late < F.lit(first + (i + 1) * span) if i < 5 else F.lit(True)
        events.where(low & high).repartition(1, "ts").write.mode("append").parquet(folder)
    closing = {"user_id": F.lit(CLOSING).cast("bigint"), "ts": F.lit(last) + F.expr("INTERVAL 200 DAYS")}
    end = events.limit(1).withColumns(closing).select(*columns)
    end.coalesce(1).write.mode("append").parquet(folder)
    session = stream_session(spark)
    return session.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def of_all_keys(spark, streamed):
    """What a stream wrote, as a table of this session, without the closing event."""
    out = run_stream(streamed.sparkSession, streamed)
    return out.where(F.col("user_id") != CLOSING)


@query(
    "stream_attempts",
    anchored_sql(DAY)
    + """ SELECT user_id, t AS instant, s AS window_start,
                 row_number() OVER (PARTITION BY user_id, s ORDER BY t) AS attempt,
                 row_number() OVER (PARTITION BY user_id, s ORDER BY t) > 4 AS over_limit
          FROM p""",
)
def stream_attempts(spark, sf):
    """Windows end in every batch: events arrive up to a day late, and two days are waited."""
    events = in_order_of_time(spark, sf, ["user_id", "ts"])
    return of_all_keys(spark, windows.stream_attempts(events, "user_id", "ts", DAY, limit=4, delay="2 days", bucket_seconds=2 * DAY))


@query(
    "stream_tumbling_counts",
    """SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start,
              count(*) AS attempts, count(*) > 4 AS over_limit FROM events GROUP BY ALL""",
)
def stream_tumbling_counts(spark, sf):
    """The closing event ends the last windows too."""
    events = in_order_of_time(spark, sf, ["user_id", "ts"])
    counts = windows.tumbling_counts(events, "user_id", "ts", DAY, limit=4, watermark="2 days")
    return of_all_keys(spark, counts).withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "stream_first_requests",
    """WITH q AS (SELECT user_id, event_type, event_id, ts, floor(value / 10) AS tier FROM events),
            f AS (SELECT *, first_value(event_id) OVER w AS winner, first_value(ts) OVER w AS t, first_value(tier) OVER w AS wanted
                  FROM q WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
       SELECT user_id, event_type, winner AS event_id, epoch_us(t) AS instant, count(*) AS requests,
              bool_or(tier IS DISTINCT FROM wanted) AS conflict FROM f GROUP BY ALL""",
)
def stream_first_requests(spark, sf):
    """Who was first by event time, and whether a later request of the key asked for something else."""
    events = in_order_of_time(spark, sf, ["user_id", "event_type", "event_id", "ts", "value"])
    asked = events.withColumn("tier", F.floor(F.col("value") / 10))
    outcomes = streamed.request_outcomes_stream(
        asked, ["user_id", "event_type"], ["tier"], "ts", "event_id", "2 days", bucket_seconds=2 * DAY
    )
    accepted = F.col("outcome") == "accepted"
    return of_all_keys(spark, outcomes).groupBy("user_id", "event_type").agg(
        F.max(F.when(accepted, F.col("id"))).alias("event_id"), F.max(F.when(accepted, F.col("instant"))).alias("instant"),
        F.count(F.lit(1)).alias("requests"), F.bool_or(F.col("outcome") == "conflict").alias("conflict"),
    )
