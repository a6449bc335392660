"""Repeated and conflicting requests in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import col, comparable, type_of
from quillgrid.plans.profile import EXACT_JSON
from quillgrid.streaming.ordered import Requests, in_event_time
from quillgrid.streaming.windows import MICROS, micros


def first_requests_stream(
    requests: DataFrame, keys: list[str], ts: str, watermark: str
) -> DataFrame:
    """The first request to arrive per key; keys are remembered for the length of the watermark."""
    if isinstance(type_of(requests, ts), T.TimestampNTZType):
        requests = requests.withColumn(ts, col(ts).cast("timestamp"))
    return requests.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def request_outcomes_stream(
    requests: DataFrame,
    keys: list[str],
    payload: list[str],
    ts: str,
    number: str,
    delay: str = "1 hour",
    bucket_seconds: int = 600,
    remember_seconds: int | None = None,
) -> DataFrame:
    """The keys, `instant`, `id` and `outcome` of every request, decided in the order of event times.

    The earliest request of a key, whenever it arrives, is `accepted`; of equal times the one with
    the least `number` is. Later ones with its payload are `repeated`, others are a `conflict`. Each
    is decided once the watermark has passed its bucket. A key is remembered for
    `remember_seconds` from its accepted request on, or for good.
    """
    values = F.struct(*[comparable(col(c), type_of(requests, c)).alias(f"c{i}") for i, c in enumerate(payload)])
    others = [col(number).alias("id"), F.to_json(values, EXACT_JSON).alias("payload")]
    remember = None if remember_seconds is None else remember_seconds * MICROS
    kind = type_of(requests, number).simpleString()
    return in_event_time(
        requests, keys, micros(requests, ts), col(ts), others, delay,
        Requests(bucket_seconds * MICROS, remember), f"instant bigint, id {kind}, outcome string",
    )
