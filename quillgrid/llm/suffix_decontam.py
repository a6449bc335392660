"""Benchmark decontamination with suffix arrays of the training texts.

Each slice of documents is a shard with a suffix array over its words. Every suffix of every
test item is looked up in it by binary search; the interval found gives all places where the
item's next words stand verbatim, and neighbouring places make up the longest matches.

The array is sparse without losing a match: it leaves out suffixes that begin with too few words
of the benchmark's own vocabulary to match any test suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import (
    carried,
    expanded,
    slices,
    span_hashes,
    text_buffer,
    text_or_empty,
    word_spans,
)

#: Benchmark text that is indexed, broadcast and searched at a time.
BLOCK_BYTES = 4 << 20
#: Text of one shard.
SHARD_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

MATCHES = "array<struct<item_id:string,item_start:long,start:long,n_words:long>>"


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash and text number of every word of the texts."""
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    starts, stops, owner = word_spans(WORD[raw], offsets)
    return span_hashes(raw, starts, stops), owner


def fixed_text(words: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    width = 4 * words.shape[1]
    return np.ascontiguousarray(words.astype(">u4")).view(f"S{width}")[:, 0]


def benchmark_index(ids: list, texts: list, window: int) -> dict | None:
    """The vocabulary and the distinct test suffixes, cut to a window, of a block of items."""
    hashes, owner = hashed_words(pa.array(texts, pa.string()))
    if not len(hashes):
        return None
    vocabulary, number = np.unique(hashes, return_inverse=True)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    width = np.minimum(counts, window)
    suffixes = np.where(counts > 0, counts - width + 1, 0)
    at = expanded(first, suffixes)
    item = np.repeat(np.arange(len(texts)), suffixes)
    length = width[item]
    columns = np.arange(window)
    table = np.where(
        columns < length[:, None], number[np.minimum(at[:, None] + columns, len(number) - 1)] + 1, 0
    ).astype(np.uint32)
    distinct, inverse = np.unique(fixed_text(table), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    ends = np.cumsum(np.bincount(inverse, minlength=len(distinct)))
    sample = order[ends - 1]
    maybe = np.zeros(1 << 20, bool)
    maybe[vocabulary & np.uint64((1 << 20) - 1)] = True
    return {
        "vocabulary": vocabulary, "maybe": maybe,
        "suffixes": table[sample], "lengths": length[sample],
        "ends": ends, "items": item[order], "places": (at - first[item])[order],
        "ids": [str(i) for i in ids],
    }


def search(index: dict, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place in a shard where a test suffix stands: word places and suffix numbers."""
    window = index["suffixes"].shape[1]
    number = np.zeros(len(hashes) + window, np.uint32)
    known = np.flatnonzero(index["maybe"][hashes & np.uint64((1 << 20) - 1)])
    place = np.searchsorted(index["vocabulary"], hashes[known])
    place = np.minimum(place, len(index["vocabulary"]) - 1)
    real = index["vocabulary"][place] == hashes[known]
    number[known[real]] = place[real] + 1
    # Words up to the next one outside the vocabulary, or in another document.
    stop = np.zeros(len(hashes) + 1, bool)
    stop[:-1] = number[: len(hashes)] == 0
    stop[1:-1] |= owner[1:] != owner[:-1]
    stop[-1] = True
    stops = np.flatnonzero(stop)
    at = np.flatnonzero(number[: len(hashes)])
    run = stops[np.searchsorted(stops, at, "right")] - at
    enough = run >= index["lengths"].min()
    at, run = at[enough], run[enough]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    columns = np.arange(window)
    table = np.where(columns < run[:, None], number[at[:, None] + columns], 0).astype(np.uint32)
    keys = fixed_text(table)
    suffix_array = np.argsort(keys, kind="stable")
    table, at = table[suffix_array], at[suffix_array]
    places, suffixes = [], []
    for length in np.unique(index["lengths"]):
        asked = np.flatnonzero(index["lengths"] == length)
        wanted, having = fixed_text(index["suffixes"][asked, :length]), fixed_text(table[:, :length])
        low = np.searchsorted(having, wanted, "left")
        high = np.searchsorted(having, wanted, "right")
        places.append(at[expanded(low, high - low)])
        suffixes.append(np.repeat(asked, high - low))
    return np.concatenate(places), np.concatenate(suffixes)


def longest_matches(
    index: dict, places: np.ndarray, suffixes: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Document, item, item word, place and words of the maximal verbatim matches."""
    if not len(places):
        return (np.zeros(0, np.int64),) * 5
    begin = np.concatenate([[0], index["ends"][:-1]])[suffixes]
    count = index["ends"][suffixes] - begin
    entry = expanded(begin, count)
    place = np.repeat(places, count)
    length = np.repeat(index["lengths"][suffixes], count)
    item, word = index["items"][entry], index["places"][entry]
    document = owner[place]
    order = np.lexsort((place, place - word, item, document))
    item, word, place = item[order], word[order], place[order]
    document, length = document[order], length[order]
    joined = np.zeros(len(place), bool)
    joined[1:] = (
        (document[1:] == document[:-1]) & (item[1:] == item[:-1])
        & (place[1:] == place[:-1] + 1) & (word[1:] == word[:-1] + 1)
    )
    head = np.flatnonzero(~joined)
    last = np.append(head[1:], len(place)) - 1
    words = place[last] + length[last] - place[head]
    return document[head], item[head], word[head], place[head], words


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The items in blocks of some BLOCK_BYTES of text, dealt by a hash of the item."""
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), text_or_empty(text_col).alias("text")
    ).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    for block in range(blocks):
        part = items
        if blocks > 1:
            part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield part.collect()


def contamination(
    df: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str,
    window: int = 13, one_in: int = 20, keep: list[str] | None = None,
) -> DataFrame:
    """`row` (the kept columns), n_words, n_hit, n_items, items, contaminated and `matches`.

    Words are runs of digits, letters and bytes beyond ASCII after lower-casing A-Z. A test
    suffix is `window` words of an item; a shorter item, unless without words, is one suffix. A
    word of a document inside any place of such a suffix is hit; `items` holds the sorted ids
    of the items found, `matches` the longest verbatim matches as word places, and a document
    is contaminated if it has hits and at least one in `one_in` of its words is hit.

    Missing texts have no words; items without words match nothing; an item without an id is
    called `None`, and rows with the same id are one item. Texts of any length are searched
    whole, repeated rows each for itself; empty tables give no rows and no hits. Documents are
    read once and never shuffled. Each block of the benchmark is of fixed size, but all of them are
    indexed by the driver and broadcast together, so memory grows with the benchmark.
    """
    context = df.sparkSession.sparkContext
    blocks = []
    for part in benchmark_blocks(benchmark, item_col, item_text_col):
        index = benchmark_index([r["item"] for r in part], [r["text"] for r in part], window)
        if index is not None:
            blocks.append(context.broadcast(index))
    rows = carried(df, keep, text_col)
    kind = rows.schema["row"].dataType.simpleString()
    schema = (
        f"row {kind}, n_words long, n_hit long, n_items long, items array<string>,"
        f" contaminated boolean, matches {MATCHES}"
    )

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owner = hashed_words(part.column("text"))
        words = np.bincount(owner, minlength=part.num_rows)
        first = np.cumsum(words) - words
        edges = np.zeros(len(hashes) + 1, np.int64)
        items: list[set] = [set() for _ in range(part.num_rows)]
        matches: list[list] = [[] for _ in range(part.num_rows)]
        for block in blocks if len(hashes) else ():
            index = block.value
            places, suffixes = search(index, hashes, owner)
            np.add.at(edges, places, 1)
            np.add.at(edges, places + index["lengths"][suffixes], -1)
            for d, i, w, p, n in zip(*longest_matches(index, places, suffixes, owner)):
                items[d].add(index["ids"][i])
                matches[d].append(
                    {"item_id": index["ids"][i], "item_start": int(w),
                     "start": int(p - first[d]), "n_words": int(n)}
                )
        hit = np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=part.num_rows)
        listed = [sorted(found) for found in items]
        match_type = pa.list_(pa.struct([
            ("item_id", pa.string()), ("item_start", pa.int64()),
            ("start", pa.int64()), ("n_words", pa.int64()),
        ]))
        columns = {
            "row": part.column("row"),
            "n_words": pa.array(words, pa.int64()),
            "n_hit": pa.array(hit, pa.int64()),
            "n_items": pa.array([len(x) for x in listed], pa.int64()),
            "items": pa.array(listed, pa.list_(pa.string())),
            "contaminated": pa.array((hit > 0) & (one_in * hit >= words)),
            "matches": pa.array(matches, match_type),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                yield shard(part)

    return rows.mapInArrow(run, schema)
