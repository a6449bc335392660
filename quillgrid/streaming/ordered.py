"""Streams whose rows are handled in the order of their event times, key by key.

Rows may arrive in any order within the watermark's delay. They wait in the state until the watermark
has passed them, when nothing earlier can come any more, and are then handled in order. Waiting
rows are dealt to buckets of time, each one an entry of its own in a keyed map, so that a batch
rewrites only the buckets it adds to, and an event-time timer at the end of every bucket releases
it. What a key has to remember is dropped by a timer too. Rows behind the watermark are dropped by
Spark.

Every access to the state is a message between two processes, so keys are dealt to a fixed number
of groups that share their entries: a batch pays for groups, not for keys. A group's entries hold a
bucket's rows of its keys, and what these remember.

The state store has to be RocksDB's; `stream_session` gives a session with it.
"""

from __future__ import annotations

import pickle
from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillgrid.functions.columns import col, type_of

#: Groups of keys per shuffle partition.
GROUPS = 8

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InEventTime(StatefulProcessor):
    """Collects rows of `instant` (microseconds) and other columns and releases them in order.

    `release(memory, row)` gives what a key remembers after a row, and the output row without the
    key; `forget_at(memory)` the moment from which on that is not needed, or None.
    """

    def __init__(self, columns: list[str], bucket: int, output: list[str]):
        """`columns` begin with `instant`; `output` are those beside the keys."""
        self.columns, self.bucket, self.output = columns, bucket, output
        self.keys: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "rows binary")
        self.memory = handle.getValueState("memory", "memory binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[int, list] = {}
        for pdf in rows:
            keys = zip(*[pdf[k].tolist() for k in self.keys])
            for of_key, *row in zip(keys, *[pdf[c].tolist() for c in self.columns]):
                added.setdefault(row[0] // self.bucket, []).append((*row, of_key))
        for bucket, new in added.items():
            held = self.waiting.getValue((bucket,))
            if held is None:
                self._wake((bucket + 1) * self.bucket)
            self.waiting.updateValue((bucket,), (pickle.dumps((pickle.loads(held[0]) if held else []) + new),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        bucket = passed // self.bucket - 1
        held = self.waiting.getValue((bucket,))
        known = self.memory.get()
        memories = pickle.loads(known[0]) if known else {}
        out: list[tuple] = []
        for *row, of_key in sorted(pickle.loads(held[0]) if held else []):
            memories[of_key], found = self.release(memories.get(of_key), row)
            out.append((*of_key, *found))
        if held is not None:
            self.waiting.removeKey((bucket,))
        ends = {k: self.forget_at(m) for k, m in memories.items()}
        memories = {k: m for k, m in memories.items() if ends[k] is None or ends[k] > passed}
        if memories:
            self.memory.update((pickle.dumps(memories),))
            following = min((ends[k] for k in memories if ends[k] is not None), default=None)
            if following is not None:
                self._wake(-(-following // self.bucket) * self.bucket)
        elif known:
            self.memory.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, *self.output])

    def _wake(self, moment: int) -> None:
        """A timer at the end of a bucket, whose length is a whole number of milliseconds."""
        self.handle.registerTimer(moment // 1000)

    @abstractmethod
    def release(self, memory, row: list) -> tuple[object, tuple]: ...

    @abstractmethod
    def forget_at(self, memory) -> int | None: ...

    def close(self) -> None:
        pass


class Attempts(InEventTime):
    """Running numbers in anchored windows; the memory is the open window's end and its count."""

    def __init__(self, length: int, limit: int, bucket: int):
        super().__init__(["instant"], bucket, ["instant", "window_start", "attempt", "over_limit"])
        self.length, self.limit = length, limit

    def release(self, memory, row):
        (t,) = row
        end, used = memory if memory is not None and t < memory[0] else (t + self.length, 0)
        return (end, used + 1), (t, end - self.length, used + 1, used >= self.limit)

    def forget_at(self, memory):
        return memory[0]


class Requests(InEventTime):
    """Outcomes of requests; the memory is the first request's payload and time."""

    def __init__(self, bucket: int, remember: int | None):
        super().__init__(["instant", "id", "payload"], bucket, ["instant", "id", "outcome"])
        self.remember = remember

    def release(self, memory, row):
        t, number, payload = row
        if memory is None or (self.remember is not None and t >= memory[1] + self.remember):
            return (payload, t), (t, number, "accepted")
        return memory, (t, number, "repeated" if payload == memory[0] else "conflict")

    def forget_at(self, memory):
        return None if self.remember is None else memory[1] + self.remember


def in_event_time(
    rows: DataFrame, keys: list[str], instant: Column, ts: Column, others: list[Column], delay: str,
    processor: InEventTime, schema: str,
) -> DataFrame:
    """Run a processor over a stream; `schema` is that of its output columns.

    Rows without a key or a time are left out. The number of groups follows the number of shuffle
    partitions, which a stream keeps for good.
    """
    processor.keys = keys
    groups = GROUPS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(groups)).alias("_group")
    slim = rows.select(group, *[col(k) for k in keys], instant.alias("instant"), ts.cast("timestamp").alias("at"), *others)
    listed = ", ".join(f"`{k}` {type_of(rows, k).simpleString()}" for k in keys)
    return (
        slim.na.drop(subset=[*keys, "instant"])
        .withWatermark("at", delay)
        .groupBy("_group")
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=f"{listed}, {schema}", outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with RocksDB as its state store, and the settings of the given one otherwise."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value is not None and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session
