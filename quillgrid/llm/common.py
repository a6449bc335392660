"""Helpers that several operators share: rows carried along, checkpoints, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import checkpointed

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)


def co_located(df: DataFrame, *keys: str) -> DataFrame:
    """Checkpointed and dealt by the keys, so that later joins on them move only the other side.

    An adaptive plan does not tell how its rows are dealt, so this one table is planned without.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.repartition(shuffle_partitions(df.sparkSession), *keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    """A text column as a string, missing text as the empty string."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def carried(df: DataFrame, keep: list[str] | None, text_col: str, alias: str = "row") -> DataFrame:
    """`alias`, a struct of the kept columns (all by default), and `text`, never null.

    Columns inside the struct cannot clash with those an operator adds.
    """
    names = df.columns if keep is None else keep
    return df.select(
        F.struct(*[F.col(f"`{name}`") for name in names]).alias(alias),
        text_or_empty(text_col).alias("text"),
    )


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some `most_bytes` of text each; a longer text is a part of its own."""
    ends = np.cumsum(text_lengths(batch.column(text)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(text_buffer(texts)[1])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_spans(
    is_word: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of word bytes; runs end at documents."""
    if not len(is_word):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(len(is_word) + 1, bool)
    edge[offsets] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a step for all spans at once."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(raw) + 8, 8), (1, 1))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
    rest = stops - starts
    hashes = rest.astype(np.uint64) * MIX_B
    at, place = np.arange(len(starts)), starts.copy()
    while len(at):
        lanes = np.ascontiguousarray(eights[place]).view(np.uint64)[:, 0]
        value = (hashes[at] ^ (lanes & masks[np.minimum(rest, 8)])) * MIX_A
        value ^= value >> np.uint64(29)
        hashes[at] = value * MIX_B
        more = rest > 8
        at, place, rest = at[more], place[more] + 8, rest[more] - 8
    return hashes ^ (hashes >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
