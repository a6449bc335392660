"""SimHash near-duplicates with pivot distance tables.

Every fingerprint has a row of a table: its Hamming distances to many fixed reference
fingerprints. Two fingerprints within `max_bits` of each other differ by at most that much in
every column, so a pair with a larger difference is discarded unseen and only survivors are
compared bit by bit.

Distances to pivots alone cannot bring pairs together without meeting every other row, so rows
meet by blocks of bits: of `max_bits` + c blocks, two close fingerprints agree in some c.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import (
    carried,
    checkpointed,
    slices,
    text_buffer,
    word_spans,
)
from quillgrid.llm.components import least_reachable

BITS = 64
#: Reference fingerprints of the distance table.
PIVOTS = 24
#: Distinct fingerprints that may meet under one key; a fuller key is split by more blocks.
MOST_IN_BUCKET = 20_000
#: Blocks to begin with, above `max_bits`, and the most that splitting goes up to.
EXTRA_BLOCKS, MOST_EXTRA_BLOCKS = 1, 5

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def simhash(documents: pa.Array, shingle: int) -> np.ndarray:
    """64-bit fingerprints of texts: majorities of the bits of their shingles' hashes.

    A-Z is lower-cased; words end at ASCII white space; a shorter text is one shingle; a text
    without words has fingerprint zero.
    """
    import xxhash

    raw, offsets = text_buffer(documents)
    raw = LOWER[raw]
    starts, stops, doc = word_spans(~SPACES[raw], offsets)
    count = len(documents)
    result = np.zeros(count, np.uint64)
    if not len(starts):
        return result
    # All words one after another with one space behind each.
    lengths = stops - starts + 1
    places = np.cumsum(lengths) - lengths
    flat = np.full(int(lengths.sum()), 32, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[places + lengths - 1] = False
    source = ~SPACES[raw]
    flat[inside] = raw[source]
    words = np.bincount(doc, minlength=count)
    first = np.cumsum(words) - words
    shingles = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    heads = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    owner = np.repeat(np.arange(count), shingles)
    tails = np.minimum(heads + shingle, first[owner] + words[owner]) - 1
    begin, end = places[heads], places[tails] + lengths[tails] - 1
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], 42) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin)
    )
    having = np.flatnonzero(shingles)
    sums = bit_sums(hashes, shingles[having])
    majority = 2 * sums > shingles[having, None]
    result[having] = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]
    return result


def bit_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in consecutive runs of `counts` hashes (none empty).

    Eight bits at a time are summed as the bytes of one word, over pieces of at most 255 hashes.
    """
    pieces = (counts + 254) // 255
    owner_first = np.cumsum(pieces) - pieces
    piece = np.arange(pieces.sum()) - np.repeat(owner_first, pieces)
    starts = np.repeat(np.cumsum(counts) - counts, pieces) + 255 * piece
    sums = np.empty((len(starts), 8, 8), np.int32)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        lanes = np.add.reduceat(lanes, starts)
        sums[:, :, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(sums.reshape(-1, 64), owner_first, axis=0)


def fingerprints(
    df: DataFrame, text_col: str, shingle: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """`row` (the kept columns) and `fp`, the fingerprint as a signed 64-bit integer.

    Missing and empty texts have fingerprint zero; texts of any length are read whole.
    """
    rows = carried(df, keep, text_col)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                marks = simhash(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(marks)], ["row", "fp"]
                )

    return rows.mapInArrow(run, f"row {kind}, fp long")


def block_masks(blocks: int, equal: int) -> list[int]:
    """For each choice of `equal` of the blocks, the bits of these, as signed integers."""
    edges = np.linspace(0, BITS, blocks + 1).astype(int).tolist()
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, equal)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def keyed(classes: DataFrame, max_bits: int, extra: int) -> DataFrame:
    """The fingerprints under each of their keys: `level`, `choice`, `key`, `fp`."""
    masks = block_masks(max_bits + extra, extra)
    choices = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                for i, m in enumerate(masks)
            ]
        )
    )
    return classes.select("fp", choices.alias("k")).select(
        F.lit(extra).alias("level"), "k.choice", "k.key", "fp"
    )


def bucketed(classes: DataFrame, max_bits: int) -> DataFrame:
    """Rows that meet: every pair within `max_bits` shares some level, choice and key.

    A key with more than MOST_IN_BUCKET fingerprints is taken apart by a finer choice of blocks;
    a pair that shares it shares one of the finer keys too. At the finest level only fingerprints
    that agree in most of their bits share a key.
    """
    parts, left = [], classes
    for extra in range(EXTRA_BLOCKS, MOST_EXTRA_BLOCKS + 1):
        rows = keyed(left, max_bits, extra)
        sizes = rows.groupBy("level", "choice", "key").agg(F.count("*").alias("size"))
        sizes = checkpointed(sizes.where(F.col("size") > 1))
        full = sizes.where(F.col("size") > MOST_IN_BUCKET)
        last = extra == MOST_EXTRA_BLOCKS or not full.take(1)
        met = sizes if last else sizes.where(F.col("size") <= MOST_IN_BUCKET)
        parts.append(rows.join(met.drop("size"), ["level", "choice", "key"], "left_semi"))
        if last:
            break
        left = checkpointed(
            rows.join(full.drop("size"), ["level", "choice", "key"], "left_semi")
            .select("fp").distinct()
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def pivots(seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def distance_table(marks: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks[:, None] ^ references[None, :]).astype(np.int8)


def small_group_links(
    groups: np.ndarray, marks: np.ndarray, table: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of sorted groups, all groups at once, by distance in the sorted order."""
    left, right = [], []
    lag = 1
    at = np.arange(len(marks))
    while True:
        at = at[at + lag < len(marks)]
        at = at[groups[at] == groups[at + lag]]
        if not len(at):
            break
        near = at
        for column in range(table.shape[1]):
            near = near[np.abs(table[near, column] - table[near + lag, column]) <= max_bits]
        near = near[np.bitwise_count(marks[near] ^ marks[near + lag]) <= max_bits]
        left.append(near)
        right.append(near + lag)
        lag += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def group_forest(marks: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint of one large group the place of its component's first one.

    A search in breadth over those not reached yet: a dense group is mostly reached at once,
    so pairs inside a component are never listed.
    """
    root = np.full(len(marks), -1)
    free = np.arange(len(marks))
    while len(free):
        first, free = free[0], free[1:]
        root[first] = first
        frontier = [first]
        while frontier and len(free):
            at = frontier.pop()
            near = np.arange(len(free))
            for column in range(table.shape[1]):
                near = near[np.abs(table[free[near], column] - table[at, column]) <= max_bits]
            near = near[np.bitwise_count(marks[free[near]] ^ marks[at]) <= max_bits]
            if len(near):
                reached = free[near]
                root[reached] = first
                frontier.extend(reached.tolist())
                free = np.delete(free, near)
    return root


#: Groups up to this size are compared together, larger ones each by itself.
SMALL_GROUP = 64


def links(met: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of fingerprints that join all within `max_bits` in a group: a forest, not all pairs.

    The rows of a key are sorted next to each other and streamed; a task holds one group or one
    Arrow batch. A group has at most MOST_IN_BUCKET fingerprints, except at the finest level of
    `bucketed`, whose keys are taken whatever their size: there a very large family of near
    copies is held and searched by one task.
    """
    ordered = met.repartition("level", "choice", "key").sortWithinPartitions("level", "choice", "key")
    references = pivots()

    def solve(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        sizes = np.diff(np.append(change, len(marks)))
        group = np.repeat(np.arange(len(change)), sizes)
        table = distance_table(marks, references)
        small = np.flatnonzero(sizes[group] <= SMALL_GROUP)
        a, b = small_group_links(group[small], marks[small], table[small], max_bits)
        left, right = [marks[small][a]], [marks[small][b]]
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            part = slice(change[g], change[g] + sizes[g])
            root = group_forest(marks[part], table[part], max_bits)
            other = root != np.arange(sizes[g])
            left.append(marks[part][other])
            right.append(marks[part][root[other]])
        columns = [pa.array(np.concatenate(side).view(np.int64)) for side in (left, right)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            new = np.stack(
                [batch.column(c).to_numpy().astype(np.int64) for c in ("level", "choice", "key")], 1
            )
            keys = np.concatenate([keys, new])
            marks = np.concatenate([marks, batch.column("fp").to_numpy().view(np.uint64)])
            same = (keys == keys[-1]).all(1) if len(keys) else np.zeros(0, bool)
            cut = len(keys) - int(same.sum())
            if cut:
                yield solve(keys[:cut], marks[:cut])
                keys, marks = keys[cut:], marks[cut:]
        if len(keys):
            yield solve(keys, marks)

    return ordered.mapInArrow(run, "a long, b long")


def classes_of(ids: DataFrame, max_bits: int) -> DataFrame:
    """`fp`, `root` (the class of linked fingerprints) and `component`, the least id of the class."""
    classes = checkpointed(ids.groupBy("fp").agg(F.min("id").alias("least")))
    forest = least_reachable(links(bucketed(classes.select("fp"), max_bits), max_bits))
    rooted = classes.join(forest.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(roots, "root").select("fp", "root", "component")


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """The id, `fp` and `component`, the least id reachable, of every row.

    Fingerprints are linked at `max_bits` or fewer differing bits, and components follow chains
    of links. Missing, empty and blank texts have fingerprint zero and are linked like any other.
    Equal texts, ties and repeated rows share a fingerprint and so a component. A missing id is
    never the least one; a component without any id has none. Other columns are ignored, and an
    empty table gives an empty result.

    Only distinct fingerprints are compared, so a group of copies is one row from there on.
    """
    ids = checkpointed(marked_ids(df, id_col, text_col, shingle))
    found = ids.join(classes_of(ids, max_bits), "fp")
    return found.select(F.col("id").alias(id_col), "fp", "component")


def marked_ids(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    marked = fingerprints(df, text_col, shingle, [id_col])
    return marked.select(F.col("row").getField(id_col).alias("id"), "fp")


def representatives(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the least id.

    Groups and special cases are those of near_duplicates. A row without an id stays only if no
    row of its group has one; of repeated rows one stays.
    """
    ids = checkpointed(marked_ids(df, id_col, text_col, shingle))
    best = F.struct(F.col("id").isNull().alias("without"), F.col("id"), F.col("fp"))
    stays = (
        ids.join(classes_of(ids, max_bits), "fp")
        .groupBy("root").agg(F.min(best).alias("best"))
        .select(F.col("best.id").alias("kept_id"), F.col("best.fp").alias("kept_fp"))
    )
    repeated = checkpointed(ids.groupBy("id").count().where("count > 1").select(F.col("id").alias("often")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.withColumn("id", F.col("row").getField(id_col))
    kept = rows.join(stays, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    if repeated.isEmpty():
        return kept.select("row.*")
    # Where an id has several rows, the fingerprint says which one stays.
    is_often = F.col("id").eqNullSafe(F.col("often"))
    several = fingerprints(rows.join(repeated, is_often, "left_semi").select("row.*"), text_col, shingle)
    several = several.withColumn("id", F.col("row").getField(id_col)).join(
        stays, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left_semi"
    )
    one_each = several.dropDuplicates(["id", "fp"]).select("row.*")
    return kept.join(repeated, is_often, "left_anti").select("row.*").unionByName(one_each)
