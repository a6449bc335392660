"""Exact long-match marking with a run-length compressed index per shard.

The repeated parts of all documents are dealt to shards (see window_exchange). A shard sorts the
suffixes of its fragments by prefix-free parsing, takes the Burrows-Wheeler transform and keeps
only its runs, with a sample of the text place at both ends of each. Inside a run the match of a
place with its neighbour in the index is that of the place before, less one byte; so matching
statistics of the whole text stream from the run ends alone, and each sample whose match is long
enough marks the windows it covers. The more repetitive the corpus, the fewer the runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.common import expanded, span_hashes, text_buffer, text_lengths
from quillgrid.llm.fm_dedup import covered
from quillgrid.llm.window_exchange import Setting, Units, marked_rows

CHUNK_BYTES = 4 << 20
#: Bytes of a shard's index, on average.
SHARD_BYTES = 2 << 20
#: Occurrences of a marker beyond which its windows go by digest.
CROWD = 16_384
#: Symbols (a byte or an end mark, 9 bits) in one sorting key.
PACKED = 7

BYTE_HASH = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (
    np.arange(1, 257, dtype=np.uint64) << np.uint64(37)
)


def ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks of the values, from 0."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def phrase_suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of every suffix of every phrase, each phrase up to its end, by doubling.

    Phrases end with a symbol that stands nowhere else in them, so none is a prefix of another.
    """
    count = len(symbols)
    end = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(count)
    key = np.zeros(count, np.int64)
    padded = np.concatenate([symbols + 1, np.zeros(PACKED, np.int64)])
    for i in range(PACKED):
        key = (key << 9) | np.where(at + i < end, padded[at + i], 0)
    rank, depth, longest = ranked(key), PACKED, int((end - at).max(initial=0))
    while depth < longest:
        following = np.where(at + depth < end, rank[np.minimum(at + depth, count - 1)] + 1, 0)
        rank = ranked(rank * (count + 1) + following)
        depth *= 2
    return rank


class RunIndex:
    """The run-length Burrows-Wheeler transform of some texts, with samples at the run ends."""

    def __init__(self, bodies: list[bytes]) -> None:
        count = len(bodies)
        raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        lengths = np.array([len(b) for b in bodies], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        marks = self.starts + lengths
        self.raw = raw
        self.symbols = raw.astype(np.int64) + 1  # 0 is the end mark
        self.symbols[marks] = 0
        self.end = np.repeat(marks, lengths + 1)
        self.places = self._sorted_suffixes(count, marks)
        transform = self.symbols[self.places - 1]
        change = np.ones(len(transform), bool)
        change[1:] = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
        self.heads = np.flatnonzero(change)
        self.run_symbols = transform[self.heads]
        # Samples on both sides of every border between runs, and how far they agree.
        border = self.heads[1:]
        self.after, self.before = self.places[border], self.places[border - 1]
        self.agree = self._common(self.before, self.after)

    def _sorted_suffixes(self, count: int, marks: np.ndarray) -> np.ndarray:
        """The suffix array by prefix-free parsing: phrases end with white space or an end mark."""
        last = self.symbols <= 33
        phrase_end = np.flatnonzero(last) + 1
        phrase_start = np.concatenate([[0], phrase_end[:-1]])
        size = phrase_end - phrase_start
        final = self.symbols[phrase_end - 1] == 0
        # The dictionary: one copy of each phrase. An end mark is no byte, so it is hashed in.
        hashes = span_hashes(self.raw, phrase_start, phrase_end) ^ final.astype(np.uint64)
        _, example, phrase = np.unique(hashes, return_index=True, return_inverse=True)
        dictionary = expanded(phrase_start[example], size[example])
        ends = np.cumsum(size[example])
        rank = phrase_suffix_ranks(self.symbols[dictionary], ends)
        base = ends - size[example]
        # The parse: phrases by rank; behind the last of a text stands a mark of its own.
        parse = np.empty(len(phrase) + count, np.int64)
        mark = np.zeros(len(parse), bool)
        slot = np.arange(len(phrase)) + np.cumsum(final) - final
        mark[slot[final] + 1] = True
        parse[slot] = rank[base[phrase]] + count
        parse[mark] = np.arange(count)
        parse_rank = self._parse_ranks(parse)
        # A suffix: the rest of its phrase, then the parse behind it.
        within = np.arange(len(self.symbols)) - np.repeat(phrase_start, size)
        rest = rank[np.repeat(base[phrase], size) + within]
        behind = np.repeat(parse_rank[slot + 1], size)
        return np.argsort(rest * len(parse) + behind, kind="stable")

    @staticmethod
    def _parse_ranks(parse: np.ndarray) -> np.ndarray:
        count, step = len(parse), 1
        rank = ranked(parse)
        while int(rank.max()) < count - 1:
            following = np.zeros(count, np.int64)
            following[:-step] = rank[step:] + 1
            rank = ranked(rank * (count + 1) + following)
            step *= 2
        return rank

    def _common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many bytes agree behind each pair of places, up to the end of either text."""
        most = np.minimum(self.end[left] - left, self.end[right] - right)
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded, (len(self.raw), 8), (1, 1))
        agree = np.zeros(len(left), np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            at = agree[active]
            a = np.ascontiguousarray(eights[left[active] + at]).view("<u8")[:, 0]
            b = np.ascontiguousarray(eights[right[active] + at]).view("<u8")[:, 0]
            differ = a ^ b
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
            agree[active] = np.minimum(at + same, most[active])
            active = active[(differ == 0) & (at + 8 < most[active])]
        return agree

    def repeated_windows(self, window: int) -> np.ndarray:
        """For every place whether the window there stands elsewhere too."""
        edges = np.zeros(len(self.symbols) + 1, np.int32)
        enough = self.agree >= window
        size = self.agree[enough] - window + 1
        for sample in (self.before[enough], self.after[enough]):
            np.add.at(edges, sample, 1)
            np.add.at(edges, sample + size, -1)
        return np.cumsum(edges[:-1]) > 0


def repeated_windows(window: int):
    """For the distinct fragments of a shard: the windows that stand in it more than once."""

    def solve(bodies: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
        index = RunIndex(bodies)
        repeated = index.repeated_windows(window)
        return np.split(repeated[expanded(index.starts, windows)], np.cumsum(windows)[:-1])

    return solve


def byte_units(batch: pa.RecordBatch) -> Units:
    raw, offsets = text_buffer(batch.column("text"))
    data = raw.tobytes()

    def owner(at: np.ndarray | None) -> np.ndarray:
        if at is None:
            return np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        return np.searchsorted(offsets, at, "right") - 1

    return Units(
        len(raw), lambda at: BYTE_HASH[raw[at]], owner, lambda first, stop: data[first:stop]
    )


def remove_repeated_bytes(
    df: DataFrame, id_col: str, text_col: str, window: int = 400, keep: list[str] | None = None,
    crowd: int = CROWD, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """`row` (the kept columns), n_bytes, n_removed, `kept` (binary) and `spans`.

    A text is its UTF-8 bytes. A byte is removed if some string of `window` bytes around it also
    starts anywhere else, in another document or in the same one; matches never cross documents.
    `kept` is what is left, which may begin or end inside a character; `spans` are the removed
    runs as first byte and length.

    Missing and empty texts, and those shorter than a window, lose nothing; texts of any length
    are read whole. Repeated rows are documents of their own, so a row that is there twice loses
    all its windows. Ids order documents in a chunk and have no effect on the result; they may
    be missing. Other columns pass in `row`, and an empty table gives an empty result. Windows by
    the crowd (markers with more than `crowd` occurrences) are told apart by 128-bit digests.
    """
    gram = 1 << (max(window // 8, 1).bit_length() - 1)
    setting = Setting(
        window, gram, crowd, chunk_bytes, shard_bytes, byte_units, repeated_windows(window), False
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("n_bytes", pa.int64())]))

    def finish(batch: pa.RecordBatch, units: Units, marked: np.ndarray) -> dict:
        gone = covered(marked, window)
        size = text_lengths(batch.column("text"))
        lost_before = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(lost_before[np.concatenate([[0], np.cumsum(size)])])
        kept, spans = [], []
        for end, count, lost in zip(np.cumsum(size).tolist(), size.tolist(), removed.tolist()):
            first = end - count
            if not lost:
                kept.append(units.content(first, end))
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(gone[first:end], prepend=False, append=False))
            stays = [0, *edges.tolist(), count]
            kept.append(
                b"".join(units.content(first + a, first + b) for a, b in zip(stays[0::2], stays[1::2]))
            )
            spans.append([{"start": a, "n_bytes": b - a} for a, b in edges.reshape(-1, 2).tolist()])
        return {
            "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, span),
        }

    return marked_rows(
        df, id_col, text_col, keep, setting,
        "n_bytes long, n_removed long, kept binary, spans array<struct<start:long,n_bytes:long>>",
        finish,
    )
