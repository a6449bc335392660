"""Periodic stretches of word sequences, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is
at least `least_length` words and `least_exponent` periods long. Per document:

1. A suffix automaton is built word by word. The suffixes of a prefix lie on the path from the
   prefix's state up the suffix links.
2. Prefix after prefix, that path is accessed in a link-cut tree over the links and recoloured with
   the prefix's end. Before that, each piece of the path has one colour: the end of the last
   earlier occurrence of its suffixes. If the distance of the two ends is a length of that piece,
   the last 2 x distance words are a square whose half is primitive. Accessing n prefixes meets
   O(n log n) pieces.
3. The first square of a run is extended to the whole run; later squares of it are known by its
   period and end.

An automaton is only needed where words recur close enough to be in a run. With
g = 1 + (e - 2) / e * least_length, every g words inside a run of exponent e recur inside the run,
so a run lies in a stretch of which every g words recur in the same stretch. Stretches are narrowed
until that holds, which leaves no run out; one automaton is built for each that is left.

Awkward rows: a missing text has no words. Rows are taken one by one, so repeated rows and ids,
ties and clashing column names change nothing, and an empty table gives no rows. A task holds one
document's words at a time beside a slice of texts, and some 700 bytes per word of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgrid.llm.common import MIX_A, MIX_B, carried, slices

#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 20


class SuffixAutomaton:
    """The states of a word sequence: the length of the longest word sequence of each, its suffix
    link, and the state of every prefix. State 0 is the empty sequence."""

    def __init__(self, words: list[int]):
        self.length = length = [0]
        self.link = link = [-1]
        self.prefix: list[int] = []
        following: list[dict[int, int]] = [{}]
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            following.append({})
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = state
                at = link[at]
            if at >= 0:
                target = following[at][word]
                if length[target] == length[at] + 1:
                    link[state] = target
                else:
                    clone = len(length)
                    length.append(length[at] + 1)
                    link.append(link[target])
                    following.append(following[target].copy())
                    while at >= 0 and following[at].get(word) == target:
                        following[at][word] = clone
                        at = link[at]
                    link[target] = link[state] = clone
            self.prefix.append(state)
            last = state


class LinkCutAccess:
    """The paths to the root of a rooted tree, kept as splay trees of equally coloured pieces.

    Node 0 is the root and belongs to no piece. A node's left child is nearer to the root. The
    colour of a piece is kept at the root of its splay tree.
    """

    def __init__(self, parent: list[int]):
        size = len(parent)
        self.up = [max(p, 0) for p in parent]
        self.left = [0] * size
        self.right = [0] * size
        self.colour = [-1] * size

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from a node to the root; yields the lowest node and the former colour
        of every piece on it, from the node upwards."""
        up, right, colours = self.up, self.right, self.colour
        below = 0
        while node:
            self._splay(node)
            former = colours[node]
            cut = right[node]
            if cut:
                colours[cut] = former
            right[node] = below
            yield node, former
            below, node = node, up[node]
        colours[below] = colour

    def _splay(self, node: int) -> None:
        """Make a node the root of its splay tree."""
        up, left, right = self.up, self.left, self.right
        top = node
        while True:
            parent = up[node]
            if not parent:
                break
            if left[parent] == node:
                on_left = True
            elif right[parent] == node:
                on_left = False
            else:
                break
            above = up[parent]
            top = parent
            if above and (left[above] == parent or right[above] == parent):
                top = above
                if (left[above] == parent) == on_left:
                    self._rotate(parent)
                else:
                    self._rotate(node)
            self._rotate(node)
        if top != node:
            self.colour[node] = self.colour[top]

    def _rotate(self, node: int) -> None:
        """Swap a node with its parent in the splay tree."""
        up, left, right = self.up, self.left, self.right
        parent = up[node]
        above = up[parent]
        if left[parent] == node:
            inner = right[node]
            left[parent] = inner
            right[node] = parent
        else:
            inner = left[node]
            right[parent] = inner
            left[node] = parent
        if inner:
            up[inner] = parent
        if above:
            if left[above] == parent:
                left[above] = node
            elif right[above] == parent:
                right[above] = node
        up[parent] = node
        up[node] = above


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """End (the last word's number) and period of squares with a primitive half: at every end, each
    period whose square was not yet seen to go on from the end before, and maybe others."""
    automaton = SuffixAutomaton(words)
    length = automaton.length
    tree = LinkCutAccess(automaton.link)
    for end, node in enumerate(automaton.prefix):
        longest, former = 0, -1
        for node, colour in tree.access(node, end):
            # The pieces go upwards: the suffixes of the last one are longer than those of this.
            if former >= 0 and length[node] < end - former <= longest:
                yield end, end - former
            longest, former = length[node], colour
        if former >= 0 and 0 < end - former <= longest:
            yield end, end - former


def runs_of(words: list[int], least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of a word sequence, by start, then period."""
    found = []
    known: dict[int, int] = {}  # the last word of the last run of each period
    size = len(words)
    for end, period in squares(words):
        if known.get(period, -1) >= end:
            continue
        start = end - 2 * period + 1
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        stop = end + 1
        while stop < size and words[stop] == words[stop - period]:
            stop += 1
        known[period] = stop - 1
        if stop - start >= max(least_length, least_exponent * period):
            found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(
    words: np.ndarray, ends: np.ndarray, least_length: int, least_exponent: int
) -> list[tuple[int, int]]:
    """First and last-but-one word of the stretches that may hold runs.

    `words` are numbers of the words of several documents, which end at `ends`.
    """
    gram = 1 + (least_exponent - 2) * least_length // least_exponent
    least = least_length - gram + 1
    if len(words) < least_length:
        return []
    marks = words.astype(np.uint64) * MIX_A
    marks ^= marks >> np.uint64(31)
    hashes = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        hashes = hashes * MIX_B + marks[i : len(words) - gram + 1 + i]
    # A gram must not go beyond its document.
    document = np.searchsorted(ends, np.arange(len(words)), "right")
    at = np.flatnonzero(document[: len(hashes)] == document[gram - 1 :])
    stretch = document[at]
    while len(at):
        # Equal hashes of unequal grams only make a stretch longer than it need be.
        keys = (hashes[at] ^ (stretch.astype(np.uint64) * MIX_A)) * MIX_B
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        kept, inside = at[again], stretch[again]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) != 1) | (inside[1:] != inside[:-1])
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(kept)))
        long = np.repeat(sizes >= least, sizes)
        number = np.cumsum(new) - 1
        if long.all() and len(kept) == len(at) and len(firsts) == len(np.unique(stretch)):
            return [(int(kept[f]), int(kept[f] + s) + gram - 1) for f, s in zip(firsts, sizes)]
        at, stretch = kept[long], number[long]
    return []


class Numbers(dict):
    """Numbers of words, given as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def collapse_runs(
    docs: DataFrame,
    text_col: str,
    least_length: int = 24,
    least_exponent: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """`row, n_words, runs, n_dropped, collapsed`: the runs (start, length, period) of every text by
    start, then period, and the words left without those that repeat a run's first period.

    Words are what blanks and the control characters 9 to 13 part. `collapsed` joins the words left
    by one space. `row` holds the kept columns (all by default).
    """
    if least_exponent < 2 or least_length < least_exponent:
        raise ValueError("A run has at least two periods, and at least as many words.")
    rows = carried(docs, keep, text_col)
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([
        rows.schema["row"],
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(run)),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("collapsed", T.StringType()),
    ])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield collapsed_slice(part, least_length, least_exponent)

    return rows.mapInArrow(collapse, schema)


def collapsed_slice(batch: pa.RecordBatch, least_length: int, least_exponent: int) -> pa.RecordBatch:
    # bytes.split() parts at exactly the blank and the control characters 9 to 13.
    texts = [text.encode().split() for text in batch.column("text").to_pylist()]
    counts = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(counts)
    numbers = Numbers()
    words = np.fromiter((numbers[w] for text in texts for w in text), np.int64, int(counts.sum()))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, stop in stretches(words, ends, least_length, least_exponent):
        at = int(np.searchsorted(ends, first, "right"))
        offset = first - int(ends[at] - counts[at])
        runs = runs_of(words[first:stop].tolist(), least_length, least_exponent)
        found[at] += [(offset + start, length, period) for start, length, period in runs]
    dropped = np.zeros(len(texts), np.int64)
    collapsed = []
    for at, (text, runs) in enumerate(zip(texts, found)):
        if runs:
            gone = np.zeros(len(text) + 1, np.int64)
            for start, length, period in runs:
                gone[start + period] += 1
                gone[start + length] -= 1
            left = np.cumsum(gone[:-1]) == 0
            dropped[at] = len(text) - int(left.sum())
            text = [text[i] for i in np.flatnonzero(left)]
        collapsed.append(b" ".join(text))
    offsets = np.cumsum([0, *map(len, found)])
    fields = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
    names = ["start", "length", "period"]
    run = pa.StructArray.from_arrays([pa.array(fields[:, i]) for i in range(3)], names)
    columns = [
        batch.column("row"),
        pa.array(counts),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), run),
        pa.array(dropped),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]
    return pa.record_batch(columns, ["row", "n_words", "runs", "n_dropped", "collapsed"])
