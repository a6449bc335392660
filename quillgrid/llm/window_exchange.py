"""Finding repeated windows of many documents, shard by shard and without all pairs.

Documents are cut into chunks. Every window of a text (20 words, 400 bytes) has a marker: the
least hash of the grams inside. Equal windows have equal markers, so runs of neighbouring windows
with one marker form a fragment, and all fragments of a marker meet in one shard:

1. Every chunk asks how often its markers occur; markers that occur once end there.
2. Every chunk sends the distinct fragments of repeated markers to their shards. A shard indexes
   them, finds their repeated windows and answers with one bit for each window asked about.
3. Every chunk marks what the answers cover.

Chunks merge their own copies before they send anything, so a group of copies weighs as much as
the number of chunks it is in. A marker with more than `crowd` occurrences (a line that a large
part of all documents holds) is not gathered in a shard: its windows go by their own 128-bit
digest, one by one, to be counted wherever the digest belongs.

Messages are rows (bucket, chunk, payload) with packed arrays, so that Spark moves few rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import (
    MIX_A,
    MIX_B,
    carried,
    checkpointed,
    co_located,
    expanded,
    shuffle_partitions,
    slices,
    sliding_min,
)

ABSENT, REPEATED, CROWDED = 0, 1, 2
#: Windows of a fragment; longer runs of one marker are cut.
LONGEST_RUN = 1024


@dataclass(frozen=True)
class Units:
    """What windows are made of in one chunk: `count` words or bytes."""

    count: int
    hashes: Callable[[np.ndarray | slice], np.ndarray]  # a hash of each of the given units
    owner: Callable[[np.ndarray | None], np.ndarray]  # the document of the given, or of all units
    content: Callable[[int, int], bytes]  # the units from one up to another, as bytes


@dataclass(frozen=True)
class Setting:
    window: int
    gram: int
    crowd: int
    chunk_bytes: int
    shard_units: int
    units: Callable[[pa.RecordBatch], Units]
    #: (contents, documents, chunks, units, counts) of a shard's fragments -> bits of each.
    solve: Callable
    #: Whether the first of equal windows is kept.
    keep_first: bool


def packed(value) -> bytes:
    data = pickle.dumps(value, protocol=5)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(payload: bytes):
    size = int.from_bytes(payload[:8], "little")
    return pickle.loads(pa.decompress(payload[8:], size, "zstd", asbytes=True))  # noqa: S301


def grams(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of `size` consecutive units (a power of two), by doubling."""
    step = 1
    if seed:
        hashes = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64))
    while step < size:
        hashes = (hashes[:-step] * MIX_A) ^ (hashes[step:] + (hashes[step:] >> np.uint64(31)))
        hashes ^= hashes >> np.uint64(29)
        hashes *= MIX_B
        step *= 2
    return hashes ^ (hashes >> np.uint64(32))


def occurrences(
    gram: np.ndarray, marker: np.ndarray, first: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """How often the marker of each fragment stands among its grams.

    A gram is the marker of some window if it equals the largest marker of the windows around.
    """
    width = len(gram) - len(marker) + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), marker, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(~sliding_min(~padded, width) == gram)
    kinds, kind = np.unique(np.concatenate([gram[at], marker[first]]), return_inverse=True)
    key = np.sort(kind[: len(at)] * len(gram) + at)
    base = kind[len(at) :] * len(gram)
    stop = np.minimum(first + length - 1 + width, len(gram))
    return np.searchsorted(key, base + stop) - np.searchsorted(key, base + first)


def fragments(units: Units, setting: Setting) -> tuple[np.ndarray, ...]:
    """Marker, first window, number of windows and occurrences of the marker of every fragment."""
    count = units.count - setting.window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    gram = grams(units.hashes(slice(None)), setting.gram)
    marker = sliding_min(gram, setting.window - setting.gram + 1)
    owner = units.owner(None)
    inside = owner[:count] == owner[setting.window - 1 :]
    change = np.ones(count, bool)
    change[1:] = (marker[1:] != marker[:-1]) | (owner[1:count] != owner[: count - 1])
    change[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(change)
    length = np.diff(np.append(first, count))
    whole = inside[first]
    first, length = first[whole], length[whole]
    pieces = (length + LONGEST_RUN - 1) // LONGEST_RUN
    nth = expanded(np.zeros(len(first), np.int64), pieces)
    first, length = np.repeat(first, pieces), np.repeat(length, pieces)
    first, length = first + nth * LONGEST_RUN, np.minimum(length - nth * LONGEST_RUN, LONGEST_RUN)
    return marker[first], first, length, occurrences(gram, marker, first, length)


def window_digests(
    units: Units, window: int, first: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window of the given fragments; nothing else of the chunk is hashed."""
    size = 1 << (window.bit_length() - 1)
    span = length + window - 1
    hashes = units.hashes(expanded(first, span))
    at = expanded(np.cumsum(span) - span, length)
    found = []
    for seed in (1, 2):
        parts = grams(hashes, size, seed)
        both = (parts[at] * MIX_B) ^ (parts[at + window - size] + MIX_A)
        found.append((both ^ (both >> np.uint64(30))) * MIX_A)
    return found[0], found[1]


class Chunk:
    """One chunk with its units, its fragments, and what it asks of whom."""

    def __init__(self, blob: bytes, asked: bytes, setting: Setting) -> None:
        self.batch = pa.ipc.open_stream(blob).read_next_batch()
        name = (self.batch.schema.metadata or {}).get(b"text")
        if name is not None:  # the text is in the row already
            text = self.batch.column("row").field(name.decode())
            self.batch = self.batch.append_column("text", text)
        self.setting = setting
        self.units = setting.units(self.batch)
        self.marker, self.first, self.length, _ = unpacked(asked)

    def codes(self, answers: list[dict], buckets: int) -> np.ndarray:
        """Absent, repeated or crowded, for each fragment."""
        distinct, inverse = np.unique(self.marker, return_inverse=True)
        codes = np.zeros(len(distinct), np.uint8)
        owner = distinct % np.uint64(buckets)
        for answer in answers:
            codes[owner == answer["bucket"]] = unpacked(answer["payload"])
        return codes[inverse]

    def requests(self, codes: np.ndarray, buckets: int) -> tuple[dict, dict]:
        """By bucket: the distinct fragments and windows to send, and which of ours they answer."""
        window, documents = self.setting.window, self._documents()
        send: dict[int, dict] = {}
        ours: dict[int, dict] = {}
        at = np.flatnonzero(codes == REPEATED)
        seen: dict[tuple[int, bytes], int] = {}
        heads, counts = [], []
        alike = np.empty(len(at), np.int64)
        take = self.units.content
        for n, (f, l) in enumerate(zip(self.first[at].tolist(), self.length[at].tolist())):
            body = take(f, f + l + window - 1)
            place = seen.setdefault((l, body), len(heads))
            if place == len(heads):
                heads.append(n)
                counts.append(0)
            counts[place] += 1
            alike[n] = place
        bodies = [body for _, body in seen]
        heads = np.array(heads, np.int64)
        counts = np.array(counts, np.int64)
        bucket = (self.marker[at][heads] % np.uint64(buckets)).astype(np.int64)
        groups = np.argsort(bucket, kind="stable")
        members = np.argsort(alike, kind="stable")
        ends = np.cumsum(np.bincount(alike, minlength=len(heads)))
        begins = ends - np.bincount(alike, minlength=len(heads))
        for part in np.split(groups, np.flatnonzero(np.diff(bucket[groups])) + 1):
            if not len(part):
                continue
            b = int(bucket[part[0]])
            start = self.first[at][heads[part]]
            send.setdefault(b, {})["fragments"] = (
                [bodies[i] for i in part.tolist()], documents[self.units.owner(start)], start,
                counts[part], self.length[at][heads[part]],
            )
            ours.setdefault(b, {})["fragments"] = [
                at[members[begins[i] : ends[i]]] for i in part.tolist()
            ]
        crowd = np.flatnonzero(codes == CROWDED)
        if len(crowd):
            windows = expanded(self.first[crowd], self.length[crowd])
            high, low = window_digests(self.units, window, self.first[crowd], self.length[crowd])
            order = np.lexsort((windows, low, high))
            high, low, windows = high[order], low[order], windows[order]
            new = np.ones(len(high), bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(high)))
            bucket = (high[heads] % np.uint64(buckets)).astype(np.int64)
            groups = np.argsort(bucket, kind="stable")
            for part in np.split(groups, np.flatnonzero(np.diff(bucket[groups])) + 1):
                b = int(bucket[part[0]])
                h = heads[part]
                send.setdefault(b, {})["windows"] = (
                    high[h], low[h], documents[self.units.owner(windows[h])], windows[h], sizes[part]
                )
                ours.setdefault(b, {})["windows"] = (h, sizes[part], windows)
        return send, ours

    def repeated(self, codes: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
        """For every unit, whether the window that starts there is one to remove."""
        marked = np.zeros(self.units.count, bool)
        _, ours = self.requests(codes, buckets)
        first_stays = self.setting.keep_first
        for answer in answers:
            sent, mine = unpacked(answer["payload"]), ours[answer["bucket"]]
            if "fragments" in mine:
                ends = np.cumsum([self.length[same[0]] for same in mine["fragments"]])
                bits = np.unpackbits(sent["fragments"], count=int(ends[-1])).astype(bool)
                for same, end in zip(mine["fragments"], ends.tolist()):
                    size = int(self.length[same[0]])
                    own = bits[end - size : end]
                    place = self.first[same]
                    marked[place[0] : place[0] + size] = own
                    if len(same) > 1:
                        later = expanded(place[1:], np.full(len(same) - 1, size))
                        marked[later] = True if first_stays else np.tile(own, len(same) - 1)
            if "windows" in mine:
                heads, sizes, windows = mine["windows"]
                bits = np.unpackbits(sent["windows"], count=len(heads)).astype(bool)
                marked[windows[heads[bits]]] = True
                later = expanded(heads + 1, sizes - 1)
                marked[windows[later]] = True
                if not first_stays:
                    marked[windows[heads[sizes > 1]]] = True
        return marked

    def _documents(self) -> np.ndarray:
        ids = self.batch.column("order_id")
        return ids.fill_null(np.iinfo(np.int64).min).to_numpy()


def chunks(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None, setting: Setting):
    """A checkpointed table of chunks with their fragments; chunk numbers stay as they are."""
    rows = carried(df, keep, text_col).select("row", "text")
    if keep is None or id_col in keep:
        rows = rows.withColumn("order_id", F.col("row").getField(id_col).cast("long"))
    else:
        raise ValueError(f"{id_col} must be among the kept columns")

    held = rows.schema["row"].dataType
    carries_text = text_col in held.names and held[text_col].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", setting.chunk_bytes):
                order = pa.compute.sort_indices(part.column("order_id"), null_placement="at_start")
                part = part.take(order)
                units = setting.units(part)
                asked = fragments(units, setting)
                if carries_text:
                    part = part.drop_columns(["text"]).replace_schema_metadata({"text": text_col})
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        pa.array([packed(asked)], pa.binary()),
                        pa.array([len(asked[0])], pa.int64()),
                    ],
                    ["chunk", "blob", "asked", "fragments"],
                )
                number += 1

    made = rows.mapInArrow(run, "chunk long, blob binary, asked binary, fragments long")
    return co_located(made, "chunk"), rows.schema["row"].dataType


def message(bucket: list, chunk: list, payload: list, more: dict | None = None) -> pa.RecordBatch:
    columns = {
        "bucket": pa.array(bucket, pa.int64()), "chunk": pa.array(chunk, pa.int64()),
        "payload": pa.array(payload, pa.binary()),
    } | {name: pa.array(values, pa.int64()) for name, values in (more or {}).items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def marker_codes(table: DataFrame, setting: Setting, buckets: int) -> DataFrame:
    """Answers (bucket, chunk, payload of codes, units of fragments that will be sent)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, asked in zip(batch.column("chunk").to_pylist(), batch.column("asked")):
                marker, _, length, times = unpacked(asked.as_py())
                distinct, inverse = np.unique(marker, return_inverse=True)
                if not len(distinct):
                    continue
                counts = np.bincount(inverse, weights=times)
                windows = np.bincount(inverse, weights=length + setting.window - 1)
                owner = (distinct % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(owner, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)
                yield message(
                    [int(owner[p[0]]) for p in parts], [chunk] * len(parts),
                    [packed((distinct[p], counts[p], windows[p])) for p in parts],
                )

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        asked = [unpacked(p.as_py()) for p in group.column("payload")]
        distinct, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked]))
        codes = np.where(counts > setting.crowd, CROWDED, np.where(counts > 1, REPEATED, ABSENT))
        codes = codes.astype(np.uint8)[inverse]
        ends = np.cumsum([len(a[0]) for a in asked])
        parts = np.split(codes, ends[:-1])
        sizes = [int(a[2][part == REPEATED].sum()) for a, part in zip(asked, parts)]
        batch = message(
            [key[0].as_py()] * len(asked), group.column("chunk").to_pylist(),
            [packed(part) for part in parts], {"units": sizes},
        )
        return pa.Table.from_batches([batch])

    sent = table.select("chunk", "asked").mapInArrow(ask, "bucket long, chunk long, payload binary")
    return sent.groupBy("bucket").applyInArrow(
        answer, "bucket long, chunk long, payload binary, units long"
    )


def by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))


def shard_answers(
    table: DataFrame, codes: DataFrame, setting: Setting, marker_buckets: int, buckets: int
) -> DataFrame:
    """Answers (bucket, chunk, payload of bits) of the shards."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, blob, asked, found = (
                    batch.column(c)[row].as_py() for c in ("chunk", "blob", "asked", "codes")
                )
                chunk = Chunk(blob, asked, setting)
                send, _ = chunk.requests(chunk.codes(found, marker_buckets), buckets)
                if send:
                    yield message(
                        list(send), [number] * len(send), [packed(s) for s in send.values()]
                    )

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        numbers = group.column("chunk").to_pylist()
        sent = [unpacked(p.as_py()) for p in group.column("payload")]
        replies: list[dict] = [{} for _ in sent]
        having = [i for i, s in enumerate(sent) if "fragments" in s]
        if having:
            parts = [sent[i].pop("fragments") for i in having]
            sizes = [len(p[0]) for p in parts]
            bits = solve_shard(parts, [numbers[i] for i in having], setting)
            for i, size in zip(having, sizes):
                own, bits = bits[:size], bits[size:]
                replies[i]["fragments"] = np.packbits(np.concatenate(own))
        having = [i for i, s in enumerate(sent) if "windows" in s]
        if having:
            parts = [sent[i]["windows"] for i in having]
            bits = solve_windows(parts, [numbers[i] for i in having], setting.keep_first)
            for i, own in zip(having, np.split(bits, np.cumsum([len(p[0]) for p in parts])[:-1])):
                replies[i]["windows"] = np.packbits(own)
        batch = message([key[0].as_py()] * len(sent), numbers, [packed(r) for r in replies])
        return pa.Table.from_batches([batch])

    joined = table.select("chunk", "blob", "asked").join(by_chunk(codes, "codes"), "chunk")
    schema = "bucket long, chunk long, payload binary"
    return joined.mapInArrow(ask, schema).groupBy("bucket").applyInArrow(answer, schema)


def solve_shard(parts: list[tuple], numbers: list[int], setting: Setting) -> list[np.ndarray]:
    """For each fragment that the chunks sent, a bit for each window."""
    bodies = [body for part in parts for body in part[0]]
    documents, units, counts, lengths = (
        np.concatenate([part[i] for part in parts]) for i in (1, 2, 3, 4)
    )
    chunk = np.repeat(np.array(numbers, np.int64), [len(part[0]) for part in parts])
    order = np.lexsort((units, chunk, documents))
    place: dict[bytes, int] = {}
    heads: list[int] = []
    same = np.empty(len(bodies), np.int64)
    for i in order.tolist():
        n = place.setdefault(bodies[i], len(heads))
        if n == len(heads):
            heads.append(i)
        same[i] = n
    heads = np.array(heads)
    total = np.bincount(same, weights=counts).astype(np.int64)
    found = setting.solve([bodies[i] for i in heads.tolist()], lengths[heads])
    if setting.keep_first:
        return [
            found[n] if heads[n] == i else np.ones(lengths[i], bool)
            for i, n in enumerate(same.tolist())
        ]
    return [
        np.ones(lengths[i], bool) if total[n] > 1 else found[n] for i, n in enumerate(same.tolist())
    ]


def solve_windows(parts: list[tuple], numbers: list[int], keep_first: bool) -> np.ndarray:
    """For each window digest that the chunks sent: whether it is one to remove."""
    high, low, documents, units, counts = (
        np.concatenate([part[i] for part in parts]) for i in range(5)
    )
    chunk = np.repeat(np.array(numbers, np.int64), [len(part[0]) for part in parts])
    order = np.lexsort((units, chunk, documents, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    bits = np.empty(len(order), bool)
    if keep_first:
        bits[order] = ~new
    else:
        group = np.cumsum(new) - 1
        bits[order] = (np.bincount(group, weights=counts[order]) > 1)[group]
    return bits


def marked_rows(
    df: DataFrame, id_col: str, text_col: str, keep: list[str] | None, setting: Setting,
    columns: str, finish: Callable[[pa.RecordBatch, Units, np.ndarray], dict],
) -> DataFrame:
    """`row` and the `columns` that `finish` makes of a chunk and its repeated windows."""
    spark = df.sparkSession
    table, kind = chunks(df, id_col, text_col, keep, setting)
    total = table.agg(F.sum("fragments")).first()[0] or 0
    marker_buckets = max(shuffle_partitions(spark), total // 500_000 + 1)
    codes = checkpointed(marker_codes(table, setting, marker_buckets))
    units = codes.agg(F.sum("units")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), units // setting.shard_units + 1)
    answers = shard_answers(table, codes, setting, marker_buckets, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                blob, asked, found, bits = (
                    batch.column(c)[row].as_py() for c in ("blob", "asked", "codes", "bits")
                )
                chunk = Chunk(blob, asked, setting)
                marked = chunk.repeated(
                    chunk.codes(found or [], marker_buckets), bits or [], buckets
                )
                made = finish(chunk.batch, chunk.units, marked)
                yield pa.RecordBatch.from_arrays(
                    [chunk.batch.column("row"), *made.values()], ["row", *made]
                )

    joined = (
        table.select("chunk", "blob", "asked")
        .join(by_chunk(codes, "codes"), "chunk", "left")
        .join(by_chunk(answers, "bits"), "chunk", "left")
    )
    return joined.mapInArrow(run, f"row {kind.simpleString()}, {columns}")
