"""Substring deduplication with a compressed FM-index per shard.

The repeated parts of all documents are dealt to shards (see window_exchange). A shard turns its
fragments into one text of word numbers and keeps the Burrows-Wheeler transform of it as a
wavelet matrix of packed bits. Every fragment then streams backwards through the index: each
word is one backward-search step, and a match that has grown to the window length is cut by its
last word before the next step, so that at every word the interval of the window starting there
is known. Windows whose interval holds an earlier place are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.common import expanded, span_hashes, text_buffer, word_spans
from quillgrid.llm.window_exchange import Setting, Units, marked_rows

CHUNK_BYTES = 4 << 20
#: Words of a shard's index, on average.
SHARD_WORDS = 400_000
#: Occurrences of a marker beyond which its windows go by digest.
CROWD = 16_384

WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


class WaveletMatrix:
    """Rank of any symbol before any place, from packed bits: one level for each symbol bit."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        current = symbols
        for level in range(levels):
            bit = (current >> (levels - 1 - level)) & 1
            padded = np.zeros((len(current) // 64 + 1) * 64, np.uint8)
            padded[: len(current)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int32)
            self.bits.append(words)
            self.before.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(len(current) - int(bit.sum()))
            chosen = bit.astype(bool)
            current = np.concatenate([current[~chosen], current[chosen]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often symbols[i] stands before places[i]."""
        low = np.zeros(len(places), np.int64)
        high = places.astype(np.int64)
        for level in range(self.levels):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            both = np.concatenate([low, high])
            word = both >> 6
            mask = (np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)
            low_ones, high_ones = ones[: len(low)], ones[len(low) :]
            low = np.where(one, self.zeros[level] + low_ones, low - low_ones)
            high = np.where(one, self.zeros[level] + high_ones, high - high_ones)
        return high - low


def suffix_array(text: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, by doubling, and the ranks of all prefixes of `shared` numbers.

    `text` must end each of its parts with a number of its own, so that no two suffixes tie.
    `shared` is a power of two.
    """
    count = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, kept = 1, rank if shared == 1 else None
    while True:
        following = np.zeros(count, np.int64)
        following[:-step] = rank[step:] + 1
        key = rank * (count + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(count, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(count, np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if step == shared:
            kept = rank
        if new.all() or step >= count:
            return order, rank if kept is None else kept


class FmIndex:
    """An FM-index over parts of a text of numbers above zero."""

    def __init__(self, parts: np.ndarray, ends: np.ndarray, window: int) -> None:
        """`parts` are all numbers one after another, part i up to ends[i]."""
        count = len(ends)
        starts = np.concatenate([[0], ends[:-1]])
        self.starts = starts + np.arange(count)  # in the text, with an end mark behind each
        self.window = window
        total = len(parts) + count
        marks = self.starts + (ends - starts)
        text = np.empty(total, np.int64)
        symbols = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[marks] = False
        symbols[inside] = parts
        text[inside] = parts + count
        text[marks] = np.arange(count)
        shared = 1 << ((window - 1).bit_length() - 1)
        places, prefix = suffix_array(text, shared)
        transform = symbols[places - 1]
        most = int(parts.max(initial=0))
        self.bits = WaveletMatrix(transform, max(most.bit_length(), 1))
        self.before = np.zeros(most + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=most + 1), out=self.before[1:])
        self.symbols, self.total = symbols, total
        # Suffixes next to each other that share window - 1 numbers, and the first of each group.
        other = np.minimum(places + (window - 1 - shared), total - 1)
        alike = np.zeros(total, bool)
        alike[1:] = (prefix[places[1:]] == prefix[places[:-1]]) & (
            prefix[other[1:]] == prefix[other[:-1]]
        )
        group = np.cumsum(~alike) - 1
        self.group_start = np.flatnonzero(~alike)[group]
        self.group_end = np.append(np.flatnonzero(~alike)[1:], total)[group]
        self.places = places

    def extend(
        self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + match from those of the match: one step backwards."""
        ranks = self.bits.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.before[symbols]
        return base + ranks[: len(low)], base + ranks[len(low) :]

    def window_intervals(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the text and interval of every window of every part, all parts streaming."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = self.starts[order], lengths[order]
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), self.total, np.int64)
        found = []
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths, -step, "left"))
            place = starts[:active] + lengths[:active] - 1 - step
            low, high = low[:active], high[:active]
            if step >= self.window:
                low, high = self.group_start[low], self.group_end[low]
            low, high = self.extend(low, high, self.symbols[place])
            if step >= self.window - 1:
                found.append((place, low, high))
        return tuple(np.concatenate(column) for column in zip(*found))


def earlier_windows(window: int):
    """For the fragments of a shard, in the order of their documents: windows that came before."""

    def solve(bodies: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
        raw, offsets = text_buffer(pa.array(bodies, pa.binary()))
        starts, stops, part = word_spans(WORD[raw], offsets)
        numbers = np.unique(span_hashes(raw, starts, stops), return_inverse=True)[1] + 1
        ends = np.cumsum(np.bincount(part, minlength=len(bodies)))
        index = FmIndex(numbers, ends, window)
        place, low, high = index.window_intervals(np.diff(ends, prepend=0))
        order = np.argsort(low, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = low[order][1:] != low[order][:-1]
        # The places of an interval are those found with it: its least one comes first.
        least = np.minimum.reduceat(place[order], np.flatnonzero(first))
        repeated = np.zeros(index.total, bool)
        earlier = least[np.cumsum(first) - 1] < place[order]
        repeated[place[order][earlier & (high - low > 1)[order]]] = True
        at = expanded(index.starts, windows)
        return np.split(repeated[at], np.cumsum(windows)[:-1])

    return solve


def word_units(batch: pa.RecordBatch) -> Units:
    raw, offsets = text_buffer(batch.column("text"))
    starts, stops, owner = word_spans(WORD[raw], offsets)
    lengths = stops - starts
    place = np.cumsum(lengths + 1) - lengths - 1
    joined: list[bytes] = []

    def content(first: int, stop: int) -> bytes:
        if not joined:  # all words with one space behind each, made when it is first asked for
            flat = np.full(int((lengths + 1).sum()), 32, np.uint8)
            inside = np.ones(len(flat), bool)
            inside[place + lengths] = False
            flat[inside] = raw[WORD[raw]]
            joined.append(flat.tobytes())
        return joined[0][begin[first] : end[stop - 1]]

    begin, end = place.tolist(), (place + lengths).tolist()
    return Units(
        len(starts), lambda at: span_hashes(raw, starts[at], stops[at]),
        lambda at: owner if at is None else owner[at], content,
    )


def covered(marked: np.ndarray, window: int) -> np.ndarray:
    """Units inside any of the marked windows."""
    edges = np.zeros(len(marked) + window + 1, np.int32)
    at = np.flatnonzero(marked)
    edges[at] += 1
    edges[at + window] -= 1
    return np.cumsum(edges[: len(marked)]) > 0


def remove_repeated_words(
    df: DataFrame, id_col: str, text_col: str, window: int = 20, keep: list[str] | None = None,
    crowd: int = CROWD, chunk_bytes: int = CHUNK_BYTES, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """`row` (the kept columns), n_words, n_removed, `kept` and `spans`.

    Words end at ASCII white space. A word is removed if some window of `window` words around it
    also starts earlier: in a document with a smaller id, or before in the same one. `kept` joins
    the words left by one space; `spans` are the removed runs as first word and length.

    The id is a whole number. A missing id is smaller than any other, and rows with the same id
    are documents of their own, in the order they are read. Missing and empty texts, and those
    shorter than a window, lose nothing; texts of any length are read whole. Other columns pass in
    `row`, and an empty table gives an empty result. Windows by the crowd (markers with more than
    `crowd` occurrences) are told apart by 128-bit digests, all others by their words.
    """
    setting = Setting(
        window, 8 if window >= 16 else 1, crowd, chunk_bytes, shard_words, word_units,
        earlier_windows(window), True,
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))

    def finish(batch: pa.RecordBatch, units: Units, marked: np.ndarray) -> dict:
        gone = covered(marked, window)
        words = np.bincount(units.owner(None), minlength=batch.num_rows)
        ends = np.cumsum(words)
        removed = np.bincount(units.owner(np.flatnonzero(gone)), minlength=batch.num_rows)
        kept, spans = [], []
        for end, count, lost in zip(ends.tolist(), words.tolist(), removed.tolist()):
            first = end - count
            if not lost:
                kept.append(units.content(first, end) if count else b"")
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(gone[first:end], prepend=False, append=False))
            runs = edges.reshape(-1, 2).tolist()
            stays = np.append(0, edges).tolist() + [count]
            pieces = [
                units.content(first + a, first + b)
                for a, b in zip(stays[0::2], stays[1::2]) if a < b
            ]
            kept.append(b" ".join(pieces))
            spans.append([{"start": a, "n_words": b - a} for a, b in runs])
        return {
            "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, span),
        }

    return marked_rows(
        df, id_col, text_col, keep, setting,
        "n_words long, n_removed long, kept string, spans array<struct<start:long,n_words:long>>",
        finish,
    )
