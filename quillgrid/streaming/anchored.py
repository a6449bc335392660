"""Anchored windows over any number of events per key, by a prefix scan over pieces.

A window opens at a key's first event, closes after a fixed time, and the next one opens at the
first event after that. Where a window starts depends on all windows before it. All keys are
treated alike:

1. Rows are sorted by key and time and dealt to pieces of about PIECE_ROWS rows, however many of
   them one key or one window holds. A key inside one piece needs nothing else.
2. For a piece whose first key began in an earlier one, a step function is computed on its own: if
   the open window ends at e, and the first event at or after e is this one, then the window that
   is open after the piece ends there. It has at most one step per row of the piece.
3. Functions of neighbouring pieces are composed two by two, level by level. Composing looks up, for
   every step's end, the next step of the right neighbour: both sides are sorted together by time
   and streamed, so that a function may have more steps than a task can hold.
4. From the top level down, every piece learns the end of the window open at its start: one look-up
   per pair of neighbours.
5. Every piece streams over its rows and places its own windows.

What the driver and the tasks hold of other pieces is one row per piece. A level moves its steps
once; there are at most as many as rows, and half as many with each level once a pair of pieces
spans a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import checkpointed

#: Rows of a piece, on average.
PIECE_ROWS = 4_000_000

NEVER = int(np.iinfo(np.int64).min)
STEPS = "run long, position long, entry long, before long, exit long"


@dataclass
class Edges:
    """Which pieces belong to one key that goes on from piece to piece.

    `member` gives the run of a piece's first key and the piece's position in it, `starts` the
    pieces in which a run begins (position 0 of the run of that number), and `first` the first
    instant of every piece.
    """

    member: dict[int, tuple[int, int]] = field(default_factory=dict)
    starts: set[int] = field(default_factory=set)
    first: dict[int, int] = field(default_factory=dict)
    size: dict[int, int] = field(default_factory=dict)  # positions of a run


def in_windows(
    rows: DataFrame, order: list[str], length: int, upper: int, piece_rows: int, running: bool
) -> DataFrame:
    """Rows with `key`, `instant` and `n` and the start of the window each is in, `window_start`.

    With `running`, also `before`: the sum of n over the rows before it in its window, in the order
    of `key`, `instant` and the columns of `order`. `upper` is a bound for the number of rows.
    """
    by = [F.col(c) for c in ("key", "instant", *order)]
    count = max(1, -(-upper // piece_rows))
    dealt = rows.repartitionByRange(count, *by).sortWithinPartitions(*by)
    pieces = checkpointed(dealt.withColumn("piece", F.spark_partition_id()))
    edges = edges_of(pieces)
    ends = entering_ends(pieces, edges, length, count) if edges.member else {}
    counts = counts_before(pieces, edges, ends, length) if running and edges.member else {}
    given = rows.columns
    names = [*given, "window_start", *(["before"] if running else [])]
    schema = rows.withColumns(
        {"window_start": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")}
    ).select(*[F.col(f"`{n}`") for n in names]).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if walk is None:
                piece = batch.column("piece")[0].as_py()
                walk = Walk(length, ends.get(piece), counts.get(piece, 0))
            start, before = walk.placed(batch)
            kept = [batch.column(n) for n in given]
            added = [pa.array(start), *([pa.array(before)] if running else [])]
            yield pa.record_batch([*kept, *added], names)

    return pieces.mapInArrow(place, schema)


def edges_of(pieces: DataFrame) -> Edges:
    """One row per piece passes through the driver."""
    at = F.struct("key", "instant")
    ends = pieces.groupBy("piece").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    earlier = Window.orderBy("piece")
    known = ends.select(
        "piece", F.col("low.instant").alias("first"),
        F.lag("high.key").over(earlier).eqNullSafe(F.col("low.key")).alias("goes_on"),
        F.col("low.key").eqNullSafe(F.col("high.key")).alias("one_key"),
    ).orderBy("piece").collect()
    edges = Edges()
    for row, following in zip(known, [*known[1:], None]):
        edges.first[row["piece"]] = row["first"]
        goes_on = row["goes_on"] and row["piece"] != known[0]["piece"]
        if goes_on:
            run, position = last
            edges.member[row["piece"]] = last = (run, position + 1)
            edges.size[run] = position + 2
        if following is not None and following["goes_on"] and not (goes_on and row["one_key"]):
            edges.starts.add(row["piece"])
            last = (row["piece"], 0)
    return edges


# --- step functions


def entering_ends(pieces: DataFrame, edges: Edges, length: int, count: int) -> dict[int, int]:
    """The end of the window that is open at the start of every piece whose first key goes on."""
    levels = [checkpointed(functions_of(pieces, edges, length))]
    # The first instant of every block; a run's first block has no events before it.
    first = {place: edges.first[piece] for piece, place in edges.member.items()}
    first |= {(run, 0): NEVER for run in edges.size}
    sizes = dict(edges.size)
    while max(sizes.values()) > 2:
        levels.append(composed(levels[-1], first, length, count))
        first = {(run, at // 2): t for (run, at), t in first.items() if at % 2 == 0}
        sizes = {run: -(-n // 2) for run, n in sizes.items()}
    known = {(run, 0): NEVER for run in edges.size}
    for functions in reversed(levels):
        left = {(run, 2 * at): end for (run, at), end in known.items()} if known else {}
        known = left | {(run, at + 1): end for (run, at), end in after(functions, left).items()}
    return {piece: known[place] for piece, place in edges.member.items()}


def functions_of(pieces: DataFrame, edges: Edges, length: int) -> DataFrame:
    """The steps of every piece that lies before the last one of a run.

    A step (before, entry] -> exit says: if the open window ends after `before` and not after
    `entry`, the window open after the piece ends at `exit`. An end after all entries stays.
    """
    member, starts, size = edges.member, edges.starts, edges.size

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, first_key, last_key = outer_segments(batches)
        if piece in starts:
            yield steps_batch(piece, 0, *one_step(last_key, length))
        if piece in member:
            run, position = member[piece]
            if position < size[run] - 1:
                yield steps_batch(run, position, *steps_of(first_key, length))

    return pieces.select("piece", "key", "instant").mapInArrow(steps, STEPS)


def outer_segments(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    """The piece's number and the distinct instants of its first and its last key."""
    piece, first, last, held = None, None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch.column("piece")[0].as_py()
        new, held = key_changes(batch, held)
        t = batch.column("instant").to_numpy()
        cuts = np.flatnonzero(new)
        if len(cuts) and last:
            last.append(t[: cuts[0]])
            first = last if first is None else first
            last = []
        if len(cuts) > 1 and first is None:
            first = [t[cuts[0] : cuts[1]]]
        last.append(t[cuts[-1] :] if len(cuts) else t)
    joined = [np.unique(np.concatenate(s)) if s else np.zeros(0, np.int64) for s in (first or last, last)]
    return piece, *joined


def key_changes(batch: pa.RecordBatch, held: pa.Array | None) -> tuple[np.ndarray, pa.Array]:
    """True where a row's key is not that of the row before; `held` is the last row's key."""
    keys = batch.column("key")
    both = keys if held is None else pa.concat_arrays([held, keys])
    try:
        codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.append(True, codes[1:] != codes[:-1])
    except pa.ArrowNotImplementedError:  # structs
        values = both.to_pylist()
        new = np.array([True, *[a != b for a, b in zip(values, values[1:])]])
    return (new if held is None else new[1:]), keys.slice(len(keys) - 1)


def one_step(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of a key's first piece, where no window is open before: one step for all."""
    return t[:1], np.array([NEVER]), last_openers(t, length)[:1] + length


def steps_of(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, the instants before them and exits for sorted distinct instants.

    A window that is open at the first instant ends less than a window length later, so only
    entries up to there, and the one after, can be met.
    """
    heads = 1 + int(np.searchsorted(t, t[0] + length))
    exits = last_openers(t, length)[:heads] + length
    # Of steps with one exit the last entry stands for all.
    at = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return t[at], np.append(NEVER, t[at[:-1]]), exits[at]


def last_openers(t: np.ndarray, length: int) -> np.ndarray:
    """For every instant the start of the last window, if a window opens there: each window leads to
    the next one, and leaps over windows are doubled until nothing changes."""
    following = np.searchsorted(t, t + length)
    leap = np.where(following < len(t), following, np.arange(len(t)))
    while True:
        further = leap[leap]
        if (further == leap).all():
            return t[leap]
        leap = further


def steps_batch(run: int, position: int, entry, before, exits) -> pa.RecordBatch:
    size = len(entry)
    columns = [np.full(size, run), np.full(size, position), entry, before, exits]
    names = [part.split()[0] for part in STEPS.split(", ")]
    return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names)


def composed(functions: DataFrame, first: dict, length: int, count: int) -> DataFrame:
    """The functions of pairs of neighbouring blocks.

    Left steps ask at their exits, right steps answer at their entries. Sorted by time downwards,
    with answers before questions, a question's answer is the last one seen. Right steps are also
    steps of the pair as far as a window open before the pair can reach them.
    """
    right = F.col("position") % 2 == 1
    rows = functions.select(
        "run", F.floor(F.col("position") / 2).alias("position"), right.alias("right"),
        F.when(right, F.col("entry")).otherwise(F.col("exit")).alias("moment"), "entry", "before", "exit",
    )
    by = [F.col("run"), F.col("position"), F.col("moment").desc(), F.col("right").desc()]
    dealt = rows.repartitionByRange(count, *by).sortWithinPartitions(*by)
    dealt = checkpointed(dealt.withColumn("part", F.spark_partition_id()))
    # The last answer of every part, for the questions at the start of the next ones.
    order = F.struct("run", "position", (-F.col("moment")).alias("order"))
    tails = dealt.where("right").groupBy("part").agg(
        F.max(F.struct("run", "position", (-F.col("moment")).alias("order"), "exit")).alias("tail")
    )
    carried, held = {}, None
    found = {r["part"]: (r["tail"]["run"], r["tail"]["position"], r["tail"]["exit"]) for r in tails.collect()}
    for part in range(count):
        carried[part] = held
        held = found.get(part, held)
    reach = {place: t + length for place, t in first.items() if t != NEVER}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                held, begun = carried[batch.column("part")[0].as_py()], True
            run, position, exits, entry, before = (
                batch.column(c).to_numpy() for c in ("run", "position", "exit", "entry", "before")
            )
            answers = batch.column("right").to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(answers, np.arange(len(run)), -1))
            at = np.maximum(last, 0)
            fits = (last >= 0) & (run[at] == run) & (position[at] == position)
            given = np.where(fits, exits[at], exits)
            if held is not None:
                early = (last < 0) & (run == held[0]) & (position == held[1])
                given = np.where(early, held[2], given)
            if last[-1] >= 0:
                k = last[-1]
                held = (run[k], position[k], exits[k])
            limits = np.array([reach.get((r, 2 * p), NEVER) for r, p in zip(run.tolist(), position.tolist())])
            kept = ~answers | (before < limits)
            yield pa.record_batch(
                [pa.array(c[kept]) for c in (run, position, entry, before, np.where(answers, exits, given))],
                ["run", "position", "entry", "before", "exit"],
            )

    return checkpointed(dealt.select("part", *rows.columns).mapInArrow(answer, STEPS))


def after(functions: DataFrame, ends: dict) -> dict:
    """The ends of the open windows after blocks, from those before them: one look-up per block."""
    if not ends:
        return {}
    spark = functions.sparkSession
    asked = spark.createDataFrame([(*place, end) for place, end in ends.items()], "run long, position long, end long")
    # At most one row per piece.
    met = functions.join(F.broadcast(asked), ["run", "position"]).where("entry >= end")
    found = met.groupBy("run", "position").agg(F.min_by("exit", "entry").alias("exit")).collect()
    return ends | {(r["run"], r["position"]): r["exit"] for r in found}


# --- placing windows


class Walk:
    """Places the windows of sorted rows, batch after batch."""

    def __init__(self, length: int, end: int | None, used: int):
        self.length = length
        self.goes_on = end is not None
        self.end = end if self.goes_on else NEVER
        self.used = used
        self.changed = False  # whether another key than the first one was seen
        self.held: pa.Array | None = None

    def placed(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The start of every row's window, and the sum of n before the row in that window."""
        new, held = key_changes(batch, self.held)
        if self.held is None:
            new[0] = not self.goes_on
            self.changed = bool(new[1:].any())
        else:
            self.changed = self.changed or bool(new.any())
        self.held = held
        t, n = batch.column("instant").to_numpy(), batch.column("n").to_numpy()
        firsts = np.flatnonzero(new)
        bounds = np.append(firsts, len(t))
        if not len(firsts) or firsts[0]:
            bounds = np.append(0, bounds)
        heads = bounds[:-1].copy()
        carried = np.zeros(len(t), bool)
        if not new[0]:
            heads[0] = int(np.searchsorted(t[: bounds[1]], self.end))
            carried[: heads[0]] = True
        opens = np.full(len(t), -1)
        stop = bounds[1:]
        at = heads
        while True:
            inside = at < stop
            at, stop = at[inside], stop[inside]
            if not len(at):
                break
            opens[at] = at
            at = next_rows(t, at, stop, t[at] + self.length)
        opener = np.maximum.accumulate(opens)
        start = t[np.maximum(opener, 0)]
        if carried.any():
            start[carried] = self.end - self.length
        total = np.cumsum(n) - n
        base = np.where(carried, -self.used, total[np.maximum(opener, 0)])
        before = total - base
        self.end = int(start[-1]) + self.length
        self.used = int(before[-1] + n[-1])
        return start, before


def next_rows(t: np.ndarray, at: np.ndarray, stop: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """The first row of each sorted stretch [at, stop) whose instant is not before the moment: by
    steps that double, then by halving, for all stretches at once."""
    low, step = at.copy(), 1
    high = np.minimum(at + 1, stop)
    growing = (high < stop) & (t[np.minimum(high, len(t) - 1)] < moment)
    while growing.any():
        low = np.where(growing, high, low)
        step *= 2
        high = np.where(growing, np.minimum(low + step, stop), high)
        growing &= (high < stop) & (t[np.minimum(high, len(t) - 1)] < moment)
    # Rows up to `low` are before the moment; `high` is not, or is the end.
    while True:
        open_ = high - low > 1
        if not open_.any():
            return high
        middle = (low + high) // 2
        is_before = t[np.minimum(middle, len(t) - 1)] < moment
        low = np.where(open_ & is_before, middle, low)
        high = np.where(open_ & ~is_before, middle, high)


def counts_before(pieces: DataFrame, edges: Edges, ends: dict[int, int], length: int) -> dict[int, int]:
    """What the window open at the start of each piece has counted in the pieces before it."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = piece = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if walk is None:
                piece = batch.column("piece")[0].as_py()
                walk = Walk(length, ends.get(piece), 0)
                only = piece in ends
            start, _ = walk.placed(batch)
            only = only and not walk.changed and bool((start == ends[piece] - length).all())
        if walk is not None:
            yield pa.record_batch(
                [pa.array([piece], pa.int64()), pa.array([walk.used]), pa.array([only])], ["piece", "used", "only"]
            )

    found = pieces.select("piece", "key", "instant", "n").mapInArrow(last, "piece long, used long, only boolean")
    counts, held = {}, 0
    for row in found.orderBy("piece").collect():
        counts[row["piece"]] = held
        # A piece inside one window adds to what was carried in.
        held = row["used"] + (held if row["only"] else 0)
    return {piece: counts[piece] for piece in ends}


def distinct_instants(key: Column, instant: Column, events: DataFrame) -> DataFrame:
    """`key, instant, n`: the events at each instant, merged before they are shuffled."""
    slim = events.select(key.alias("key"), instant.alias("instant")).na.drop()
    return slim.groupBy("key", "instant").agg(F.count(F.lit(1)).alias("n"))
