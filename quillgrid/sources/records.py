"""Records of text files whose records may span lines, read by many tasks.

A file is read as lines (CSV) or as the stretches between closing braces (JSON), which Spark deals
out by byte ranges. Where a range begins, a reader does not know whether it is inside quotes. So

1. every range is scanned once for each state it may begin in, which gives a function from the state
   at its start to that at its end,
2. the driver chains these functions, one small row per range, as many as Spark itself plans,
3. every range is read again from its true state on and gives its whole records; the ends of records
   that began in an earlier range are put together by a small group per record.

A text that no range ends inside of needs no third step besides reading, and files whose records
are all lines are left to Spark's own reader.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a row of `assembled` is to be understood.
RECORD, FIRST, PART = 0, 1, 2

RANGE = "file long, start long"


@dataclass(frozen=True)
class Ranges:
    """What is known of every range: the state it begins in, and whether a record spans its pieces
    or its end."""

    begins: dict[tuple[int, int], tuple]
    ends_open: set[tuple[int, int]]
    spanning: bool
    files: dict[int, str]
    final: dict[int, tuple]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """`value, file, start`: the stretches between separators, with a number for their file and the
    start of the range they were read with, in the order of the range."""
    text = spark.read.text(path, lineSep=separator)
    return text.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def ranges_of(
    values: DataFrame, scan: Callable, chain: Callable, begin: tuple, is_open: Callable
) -> Ranges:
    """Scan every range and chain the functions found.

    `scan` makes a scanner of a range, `chain(function, state)` gives the state after a range and
    whether a record spans pieces in it, `is_open(state)` whether a record goes on. `begin` is the
    state at the start of a file.
    """
    schema = f"{RANGE}, function binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scanner = None, None
        for key, texts in by_range(batches):
            if key != held:
                if scanner is not None:
                    yield found(held, scanner)
                held, scanner = key, scan()
            scanner.add(texts)
        if scanner is not None:
            yield found(held, scanner)

    def found(key: tuple[int, int], scanner) -> pa.RecordBatch:
        columns = [pa.array([key[0]]), pa.array([key[1]]), pa.array([scanner.function()], pa.binary())]
        return pa.record_batch(columns, ["file", "start", "function"])

    begins, ends_open, final, spanning = {}, set(), {}, False
    known = values.mapInArrow(run, schema).groupBy("file", "start").agg(F.collect_list("function").alias("functions"))
    last = None
    for row in known.orderBy("file", "start").collect():
        if len(row["functions"]) != 1:
            raise ValueError("Two files have one number, or a range was read by two tasks.")
        key = (row["file"], row["start"])
        if last is None or last[0] != key[0]:
            state = begin
        elif is_open(state):
            ends_open.add(last)
        begins[key] = state
        state, spans = chain(row["functions"][0], state)
        spanning |= spans
        final[key[0]] = state
        last = key
    names = {r["file"]: r["path"] for r in file_numbers(values.sparkSession, values.inputFiles()).collect()}
    if len(names) < len(set(values.inputFiles())):
        raise ValueError("Two files have one number.")
    return Ranges(begins, ends_open, spanning, names, final)


def file_numbers(spark: SparkSession, paths: list[str]) -> DataFrame:
    named = spark.createDataFrame([(p,) for p in paths], "path string")
    return named.select(F.xxhash64("path").alias("file"), "path")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """The texts of a batch, cut where another range begins."""
    for batch in batches:
        file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        new = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        bounds = [0, *new.tolist(), batch.num_rows]
        for i, j in zip(bounds, bounds[1:]):
            if j > i:
                yield (int(file[i]), int(start[i])), batch.column("value").slice(i, j - i)


def assembled(values: DataFrame, ranges: Ranges, reader: Callable, separator: str) -> DataFrame:
    """`file, kind, record`: every record; kind FIRST marks the first one of a file.

    `reader(state)` takes the pieces of a range and gives its whole records, and the parts of
    records that go on from the range before or into the next one.
    """
    begins, ends_open = ranges.begins, ranges.ends_open
    schema = "file long, start long, kind int, place int, begins boolean, record string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reading = None, None
        for key, texts in by_range(batches):
            if key != held:
                if reading is not None:
                    yield from rows(held, reading.finish())
                if key not in begins:
                    raise ValueError("The files were dealt to ranges in another way than before.")
                held, reading = key, reader(begins[key], key[1] == 0, key in ends_open)
            yield from rows(key, reading.add(texts))
        if reading is not None:
            yield from rows(held, reading.finish())

    def rows(key: tuple[int, int], found: tuple) -> Iterator[pa.RecordBatch]:
        kinds, places, starts, records = found
        n = len(records)
        if n:
            columns = [
                pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(kinds, pa.int32()),
                pa.array(places, pa.int32()), pa.array(starts, pa.bool_()), pa.array(records, pa.string()),
            ]
            yield pa.record_batch(columns, ["file", "start", "kind", "place", "begins", "record"])

    whole = values.mapInArrow(run, schema).where(F.col("kind") != PART).select("file", "kind", "record")
    if not ends_open:
        return whole
    # Only ranges beside an open border hold parts.
    order = sorted(begins)
    beside = {k for a, b in zip(order, order[1:]) if a in ends_open and a[0] == b[0] for k in (a, b)}
    listed = values.sparkSession.createDataFrame(sorted(beside), RANGE)
    # One row per range, as many as Spark plans itself.
    near = values.join(F.broadcast(listed), ["file", "start"], "left_semi").select("value", "file", "start")
    parts = near.mapInArrow(run, schema).where(F.col("kind") == PART)
    by_place = "PARTITION BY file ORDER BY start, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    numbered = parts.withColumn("number", F.expr(f"sum(int(begins)) OVER ({by_place})"))
    joined = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("parts")
    )
    first = (F.col("parts")[0]["start"] == 0) & (F.col("parts")[0]["place"] == 0)
    return whole.unionByName(joined.select(
        "file", F.when(first, FIRST).otherwise(RECORD).alias("kind"),
        F.array_join(F.transform("parts", lambda p: p["record"]), separator).alias("record"),
    ))


# --- CSV: lines, inside or outside of quotes

#: From inside quotes to behind the quote that ends them; two quotes are one quote inside.
CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


class Quotes:
    """Whether a line ends inside quotes. A quote opens a cell only at the cell's start; with
    `blanks` white space may stand before it."""

    def __init__(self, blanks: bool):
        self.opening = re.compile(r'(?:^|,)[ \t]*"' if blanks else r'(?:^|,)"')

    def after(self, line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                found = CLOSING.match(line, at)
                if found is None:
                    return True
            else:
                found = self.opening.search(line, at)
                if found is None:
                    return False
            at, inside = found.end(), not inside


class QuoteScan:
    """The states after a range that begins outside or inside quotes, and whether a record spans
    lines in it, as four bytes."""

    def __init__(self, quotes: Quotes):
        self.quotes = quotes
        self.states = [False, True]
        self.spans = [False, True]

    def add(self, lines: pa.Array) -> None:
        if pc.any(pc.match_substring_regex(lines, "\r.")).as_py():
            self.spans = [True, True]  # Spark's line reader would end a line there
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            outside, inside = self.states
            after = self.quotes.after(line, outside)
            self.states = [after, after if inside == outside else self.quotes.after(line, inside)]
            self.spans = [a or b for a, b in zip(self.spans, self.states)]

    def function(self) -> bytes:
        return bytes([*map(int, self.states), *map(int, self.spans)])


def chained_quotes(function: bytes, state: tuple) -> tuple[tuple, bool]:
    return (function[state[0]],), bool(function[2 + state[0]])


class QuotedRecords:
    """The records of a range of lines that begins in a given state."""

    def __init__(self, quotes: Quotes, state: tuple, first: bool, ends_open: bool):
        self.quotes = quotes
        self.inside = bool(state[0])
        self.goes_on = self.inside
        self.first = first
        self.held: list[str] = []
        self.ends_open = ends_open

    def add(self, lines: pa.Array) -> tuple:
        has_quote = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
        texts = lines.to_pylist()
        if not has_quote.any() and not self.inside:
            return self._rows([t.removesuffix("\r") for t in texts], [])
        whole, parts = [], []
        for text, quote in zip(texts, has_quote.tolist()):
            if quote:
                self.inside = self.quotes.after(text, self.inside)
            if self.inside:
                self.held.append(text)
                continue
            self.held.append(text.removesuffix("\r"))
            record = "\n".join(self.held)
            self.held = []
            if self.goes_on:
                parts.append((0, False, record))
                self.goes_on = False
            else:
                whole.append(record)
        return self._rows(whole, parts)

    def finish(self) -> tuple:
        """What is left open at the end of the range goes on in the next one, if there is one."""
        if not self.held:
            return [], [], [], []
        record = "\n".join(self.held)
        self.held = []
        if not self.ends_open and not self.goes_on:
            return self._rows([record], [])
        return self._rows([], [(0 if self.goes_on or self.first else 1, not self.goes_on, record)])

    def _rows(self, whole: list[str], parts: list[tuple]) -> tuple:
        kinds = [RECORD] * len(whole)
        if whole and self.first:
            kinds[0], self.first = FIRST, False
        kinds += [PART] * len(parts)
        places = [0] * len(whole) + [p[0] for p in parts]
        starts = [True] * len(whole) + [p[1] for p in parts]
        return kinds, places, starts, whole + [p[2] for p in parts]


def csv_ranges(spark: SparkSession, path: str, blanks: bool = False) -> tuple[DataFrame, Ranges, Quotes]:
    """The lines of CSV files and what is known of their ranges."""
    quotes = Quotes(blanks)
    lines = pieces(spark, path, "\n")
    found = ranges_of(lines, lambda: QuoteScan(quotes), chained_quotes, (0,), lambda state: state[0])
    return lines, found, quotes


def csv_records(lines: DataFrame, ranges: Ranges, quotes: Quotes) -> DataFrame:
    return assembled(lines, ranges, lambda *known: QuotedRecords(quotes, *known), "\n")


# --- JSON: stretches between closing braces, with a depth and inside or outside of strings

#: A whole string, and the rest of one.
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
BEFORE_RECORD = re.compile(r"\s*[\[,]?\s*")


def after_piece(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string goes on after the piece, and by how much it is deeper, without the brace
    that follows it."""
    if inside:
        end = STRING_END.match(piece)
        if end is None:
            return True, 0
        piece = piece[end.end() :]
    rest = STRING.sub("", piece)
    cut = rest.find('"')
    rest = rest if cut < 0 else rest[:cut]
    return cut >= 0, rest.count("{") + rest.count("[") - rest.count("]")


class DepthScan:
    """For a range that begins outside or inside a string: how it ends and how much deeper; and the
    first character that is no white space."""

    def __init__(self):
        self.states = [(False, 0), (True, 0)]
        self.first = ""

    def add(self, pieces: pa.Array) -> None:
        for piece in pieces.to_pylist():
            self.first = self.first or piece.lstrip("\ufeff \t\r\n")[:1]
            self.states = [self._next(piece, *state) for state in self.states]

    @staticmethod
    def _next(piece: str, inside: bool, depth: int) -> tuple[bool, int]:
        inside, deeper = after_piece(piece, inside)
        return inside, depth + deeper - (not inside)

    def function(self) -> bytes:
        return json.dumps([self.states, self.first]).encode()


def chained_depth(function: bytes, state: tuple) -> tuple[tuple, bool]:
    """States are (inside a string, depth, depth of the records or None before the first text)."""
    states, first = json.loads(function)
    inside, depth, base = state
    if base is None and first:
        base = int(first == "[")
    now, deeper = states[int(inside)]
    return (now, depth + deeper, base), True


class BracedRecords:
    """The records of a range of pieces that begins in a given state."""

    def __init__(self, state: tuple, first: bool, ends_open: bool):
        self.inside, self.depth, self.base = state
        self.goes_on = is_open_depth(state)
        self.ends_open = ends_open
        self.held: list[str] = []

    def add(self, pieces: pa.Array) -> tuple:
        whole, parts = [], []
        for piece in pieces.to_pylist():
            if self.base is None and (first := piece.lstrip("\ufeff \t\r\n")[:1]):
                self.base = int(first == "[")
            self.inside, deeper = after_piece(piece, self.inside)
            self.depth += deeper - (not self.inside)
            self.held.append(piece)
            if self.inside or self.depth != self.base:
                continue
            if self.goes_on:
                parts.append((0, False, "}".join([*self.held, ""])))
                self.goes_on = False
            else:
                whole.append(record_in("}".join([*self.held, ""])))
            self.held = []
        return braced_rows(whole, parts)

    def finish(self) -> tuple:
        """What is left is a part of a record that goes on, or the end of the file."""
        if not self.held:
            return braced_rows([], [])
        text = "}".join(self.held)
        if self.ends_open:
            return braced_rows([], [(0 if self.goes_on else 1, not self.goes_on, text)])
        if text.strip("\ufeff \t\r\n").removeprefix("[").lstrip() not in ("", "]"):
            raise ValueError(f"Something else than a record: {text.strip()[:200]}")
        return braced_rows([], [])


def record_in(text: str) -> str:
    """A record without the bracket, comma and white space before it."""
    record = text.removeprefix("\ufeff")
    record = record[BEFORE_RECORD.match(record).end() :]
    if not record.startswith("{"):
        raise ValueError(f"Something else than a record: {record[:200]}")
    return record


def braced_rows(whole: list[str], parts: list[tuple]) -> tuple:
    kinds = [RECORD] * len(whole) + [PART] * len(parts)
    places = [0] * len(whole) + [p[0] for p in parts]
    return kinds, places, [True] * len(whole) + [p[1] for p in parts], whole + [p[2] for p in parts]


def is_open_depth(state: tuple) -> bool:
    inside, depth, base = state
    return bool(inside) or (base is not None and depth != base)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """`record`: the text of every record of files that hold an array of records, or one record."""
    found = pieces(spark, path, "}")
    ranges = ranges_of(found, DepthScan, chained_depth, (False, 0, None), is_open_depth)
    for file, (inside, depth, base) in ranges.final.items():
        # Behind the last brace stands the array's end; the piece there counts as one more level.
        if inside or depth != -1 and (base, depth) not in ((0, 0), (None, 0)):
            raise ValueError(f"The records never end in {ranges.files.get(file, path)}.")
    records = assembled(found, ranges, BracedRecords, "}")
    return records.select(F.regexp_replace("record", r"^\x{FEFF}?\s*[\[,]?\s*", "").alias("record"))
