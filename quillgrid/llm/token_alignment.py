"""Alignment of the tokens of two tokenizers over the same bytes, and its statistics.

A byte-level BPE (A) and a sentence-piece BPE with byte fallback (B) encode the same bytes, a blank
and the text. Where a token of A and one of B both end, a group ends; a group is the smallest piece
of text in which tokens of both can be compared. Tokens of one group are linked.

Some cuts are certain whatever stands around them: before a blank that follows a character which is
no white space. A's pre-tokenizer always ends a word there, and no piece of B holds a blank after
another character (checked when the model is loaded). A piece of text is therefore a fragment
(open prefix, closed groups, open suffix): what stands before its first certain cut and from its
last one on waits for the neighbours, the rest is aligned at once. Fragments compose

    (p, C, s) . (q, D, t) = (p, C + groups of (s + q) + D, t)

which is associative, with the empty text as its neutral element, so that fragments can be
composed in any tree:

1. Texts of up to `long_bytes` are closed fragments by themselves. Longer ones are cut into
   pieces of `piece_chars` characters wherever that falls, every piece becomes a fragment in a task
   of its own, and the fragments of a text are composed FAN at a time, level by level. Closed parts
   stay in rows; what is composed is only the open text and the order of the closed parts.
2. Between two certain cuts stands a unit, mostly a word. The distinct units of a chunk are encoded
   and aligned once, all of them together.
3. A chunk of some megabytes of text lists its pairs of linked ids with the number of its documents
   that hold them; Spark sums these over the corpus, and every chunk gets back the counts of its own
   pairs. A pair that occurs everywhere is one row per chunk.

Awkward rows. A text that is null, empty or whose tokens do not spell a blank and the text again
(a text that holds U+2581) has no tokens: its counts are zero and its groups are the empty string.
Rows are taken one by one: equal ids or texts count as so many documents. An empty table gives
no rows. Columns other than the text are carried in a struct, so names cannot clash. The parts of
a text without any certain cut are held by one task, as both tokenizers need them whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillgrid.llm.common import carried, checkpointed, expanded, shuffle_partitions, slices

#: Bytes of text of a chunk.
CHUNK_BYTES = 4 << 20
#: Texts with more bytes than this are cut into pieces of so many characters.
LONG_BYTES, PIECE_CHARS = 2 << 20, 1 << 20
#: Fragments that are composed at once.
FAN = 64
#: Units that are handed to the tokenizers at once.
BLOCK = 20_000
#: Units that are encoded as one text, and characters of a unit that is not.
JOINED, LONG_UNIT = 200, 4_096
# Fixed value: how byte-level tokenizers split words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links of a group from which on its equal ids are merged.
LARGE_GROUP = 4_096
#: Bytes of a tokenizer file that may be broadcast.
MOST_MODEL_BYTES = 64 << 20

BLANK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
OPEN = -1


# --- certain cuts and fragments


def is_cut(before: str, after: str) -> bool:
    """Whether a unit certainly ends between two neighbouring characters."""
    return after == " " and not before.isspace() and before != BLANK


@dataclass(frozen=True)
class Fragment:
    """A piece of text: up to its first certain cut, and from its last one on. A piece without a
    certain cut is all prefix."""

    prefix: str
    closed: bool
    suffix: str


EMPTY = Fragment("", False, "")


def fragment_of(text: str) -> tuple[Fragment, str]:
    """The fragment of a text and the closed text between its first and last cut."""
    first = next_cut(text, 1)
    if first < 0:
        return Fragment(text, False, ""), ""
    last = len(text)
    while True:
        last = text.rindex(" ", 0, last)
        if is_cut(text[last - 1], " "):
            return Fragment(text[:first], True, text[last:]), text[first:last]


def next_cut(text: str, start: int) -> int:
    while (start := text.find(" ", start)) > 0:
        if is_cut(text[start - 1], " "):
            return start
        start += 1
    return -1


def composed(left: Fragment, right: Fragment) -> tuple[Fragment, str]:
    """Two neighbouring fragments as one, and the text that becomes closed between them."""
    tail = left.suffix if left.closed else left.prefix
    if not tail and not left.closed:
        return right, ""
    if not right.prefix:
        return left, ""
    if is_cut(tail[-1], right.prefix[0]):
        between = (left.suffix if left.closed else "") + (right.prefix if right.closed else "")
        suffix = right.suffix if right.closed else right.prefix
        return Fragment(left.prefix, True, suffix), between
    if left.closed and right.closed:
        return Fragment(left.prefix, True, right.suffix), left.suffix + right.prefix
    if left.closed:
        return Fragment(left.prefix, True, left.suffix + right.prefix), ""
    return Fragment(left.prefix + right.prefix, right.closed, right.suffix), ""


# --- two tokenizers and the units between certain cuts


def byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: a byte that Latin-1 prints is
    itself, the others follow from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class TwoTokenizers:
    """Both tokenizers and the bytes of every token."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        told = json.loads(a_json)
        splits = told.get("pre_tokenizer") or {}
        if splits.get("type") != "ByteLevel" or not splits.get("use_regex", True):
            raise ValueError("The first tokenizer is to be a byte-level one that splits words.")
        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        if "".join(self.b.encode("  x  y ", out_type=str)) != "   x  y ".replace(" ", BLANK):
            raise ValueError("The second tokenizer changes white space, so no cut is certain.")
        self.blank = self.b.piece_to_id(BLANK)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(BLANK in piece.lstrip(BLANK) for piece in pieces):
            raise ValueError("The second tokenizer has pieces that go on after a word.")
        of = byte_of_character()
        vocabulary = self.a.get_vocab(False)
        self.a_bytes = {i: bytes(of[c] for c in t) for t, i in vocabulary.items()}
        if not {bytes([b]) for b in range(256)} <= set(self.a_bytes.values()):
            raise ValueError("The first tokenizer has no token for some byte.")
        self.fast_a = None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
        made = [vocabulary[m] for m in merged]
        if made == sorted(made) and not told["model"].get("ignore_merges"):
            # Ids in the order of the merges: the same encoding by ranks, which is faster.
            ranks = {token: i for i, token in self.a_bytes.items()}
            self.fast_a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]

        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, token in self.a_bytes.items():
            self.a_sizes[i] = len(token)
        self.b_sizes = np.array([len(token) for token in self.b_bytes])
        # How ids are written in front of another id of their side, and at the end of their side.
        self.a_texts = [f"{i}{mark}" for i in range(len(self.a_sizes)) for mark in ",|"]
        b_texts = [f"{i}{mark}" for i in range(len(self.b_sizes)) for mark in ",;"]
        self.texts = self.a_texts + b_texts

    def encode_a(self, texts: list[str]) -> np.ndarray:
        """Ids of A for a blank and each text, one text after another.

        Units that end at certain cuts are encoded as one text; long ones and those that end with
        white space by themselves.
        """
        ids: list[list[int]] = []
        held: list[str] = []

        def flush() -> None:
            if held:
                ids.append(self.fast_a.encode_ordinary(" " + " ".join(held)))
                held.clear()

        for text in texts:
            if self.fast_a is None or not text or text[-1].isspace() or len(text) > LONG_UNIT:
                flush()
                ids.append(self.a.encode(f" {text}", add_special_tokens=False).ids)
            else:
                held.append(text)
                if len(held) == JOINED:
                    flush()
        flush()
        return flattened(ids)[0]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of B for each text, which B puts a blank before. For no text at all it leaves the blank
        out, which here stands at the end of a longer text."""
        found = self.b.encode(texts, num_threads=1)
        return [ids if text else [self.blank] for text, ids in zip(texts, found)]


class Numbers(dict):
    """Numbers of units, without the blank they begin with, as they are met.

    A word that does not end where a unit ends has the number OPEN. A unit that ends only because
    the text does has a key of its own.
    """

    def __init__(self):
        super().__init__()
        self.texts: list[str] = []

    def __missing__(self, word) -> int:
        text = word if isinstance(word, str) else word[0]
        if isinstance(word, str) and (not text or text[-1].isspace() or text[-1] == BLANK):
            self[word] = OPEN
            return OPEN
        self[word] = number = len(self.texts)
        self.texts.append(text)
        return number

    def of(self, text: str) -> list[int]:
        """The numbers of a text's units; the text follows a blank."""
        words = text.split(" ")
        numbers = list(map(self.__getitem__, words))
        if OPEN not in numbers:
            return numbers
        whole, held = [], []
        for word, number in zip(words, numbers):
            held.append(word)
            if number != OPEN:
                whole.append(number if len(held) == 1 else self[" ".join(held)])
                held = []
        if held:
            whole.append(self[(" ".join(held),)])
        return whole


@dataclass
class Units:
    """The alignment of distinct units: the counts of each, whether the bytes agree, how its groups
    are written, and its links as id pairs with the number of each."""

    counts: np.ndarray
    agrees: np.ndarray
    lines: list[str]
    pair_ends: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray


def aligned_units(tokenizers: TwoTokenizers, texts: list[str]) -> Units:
    """Align units block by block, all units of a block at once."""
    blocks = [aligned_block(tokenizers, texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]
    blocks = blocks or [aligned_block(tokenizers, [])]
    shifts = np.cumsum([0, *[len(b.pairs) for b in blocks]])
    return Units(
        np.concatenate([b.counts for b in blocks], axis=1),
        np.concatenate([b.agrees for b in blocks]),
        [line for b in blocks for line in b.lines],
        np.concatenate([[0], *[b.pair_ends + shift for b, shift in zip(blocks, shifts)]]),
        np.concatenate([b.pairs for b in blocks]),
        np.concatenate([b.weights for b in blocks]),
    )


def aligned_block(tokenizers: TwoTokenizers, texts: list[str]) -> Units:
    """`pair_ends` is without the 0 at its start here."""
    wanted = [f" {text}".encode() for text in texts]
    sizes = np.fromiter(map(len, wanted), np.int64, len(texts))
    # The bytes of A's tokens are those of the units, which all end where a token ends.
    a = tokenizers.encode_a(texts)
    a_unit = np.searchsorted(np.cumsum(sizes), np.cumsum(tokenizers.a_sizes[a]))
    ids = tokenizers.encode_b(texts)
    b, b_counts = flattened(ids)
    b_unit = np.repeat(np.arange(len(texts)), b_counts)
    agrees = sums_by(b_unit, tokenizers.b_sizes[b], len(texts)) == sizes
    # With equal lengths everywhere, equal bytes of all units are equal bytes of each.
    if not agrees.all() or b"".join(map(tokenizers.b_bytes.__getitem__, b.tolist())) != b"".join(wanted):
        for k, (found, want) in enumerate(zip(ids, wanted)):
            agrees[k] &= b"".join(map(tokenizers.b_bytes.__getitem__, found)) == want
        a, a_unit = a[agrees[a_unit]], a_unit[agrees[a_unit]]
        b, b_unit = b[agrees[b_unit]], b_unit[agrees[b_unit]]
    a_counts, b_counts = (np.bincount(unit, minlength=len(texts)) for unit in (a_unit, b_unit))
    # Ends of tokens on one line of bytes; both tokenizers end every unit.
    a_ends, b_ends = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
    a_last, b_last = np.isin(a_ends, b_ends, True), np.isin(b_ends, a_ends, True)
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    groups = int(a_last.sum())
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    of_group = a_unit[a_last]
    links = in_a * in_b
    counts = np.array([
        a_counts, b_counts, np.bincount(of_group, minlength=len(texts)), sums_by(of_group, links, len(texts)),
    ])
    pair_unit, pairs, weights = linked_pairs(a, b, in_a, in_b, of_group)
    ends = np.cumsum(np.bincount(pair_unit, minlength=len(texts)))
    return Units(counts, agrees, lines_of(tokenizers, a, b, a_last, b_last, in_a, in_b, a_counts + b_counts), ends, pairs, weights)


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def lines_of(tokenizers, a, b, a_last, b_last, in_a, in_b, per_unit) -> list[str]:
    """The groups of every unit as text, each followed by a semicolon: in every group the ids of A
    come first."""
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)
    code = np.empty(len(a) + len(b), np.int64)
    code[at_a] = 2 * a + a_last
    code[at_b] = 2 * b + b_last + len(tokenizers.a_texts)
    texts = tokenizers.texts
    written = [texts[c] for c in code.tolist()]
    ends = np.cumsum(per_unit).tolist()
    return ["".join(written[i:j]) for i, j in zip([0, *ends], ends)]


def linked_pairs(a, b, in_a, in_b, of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, id pair and number of links, sorted by unit. In a large group equal ids are merged
    first, so that what is listed is bounded by the vocabularies."""
    starts_a, starts_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    large = np.flatnonzero(in_a * in_b > LARGE_GROUP)
    small = np.where(in_a * in_b > LARGE_GROUP, 0, in_b)
    # Every token of A with every one of B in its group.
    per_token = np.repeat(small, in_a)
    left = np.repeat(a, per_token)
    right = b[expanded(np.repeat(starts_b, in_a), per_token)]
    units = [np.repeat(np.repeat(of_group, in_a), per_token)]
    pairs, weights = [left << 32 | right], [np.ones(len(left), np.int64)]
    for g in large.tolist():
        i, n = np.unique(a[starts_a[g] : starts_a[g] + in_a[g]], return_counts=True)
        j, m = np.unique(b[starts_b[g] : starts_b[g] + in_b[g]], return_counts=True)
        pairs.append((i[:, None] << 32 | j[None, :]).ravel())
        weights.append((n[:, None] * m[None, :]).ravel())
        units.append(np.full(len(pairs[-1]), of_group[g]))
    units, pairs, weights = (np.concatenate(x) for x in (units, pairs, weights))
    order = np.argsort(units, kind="stable") if len(large) else slice(None)
    return units[order], pairs[order], weights[order]


@dataclass
class Aligned:
    """The alignment of several texts: per text the counts, the groups' line, and its pairs as
    places in the sorted list of all pairs, with the number of links of each."""

    counts: np.ndarray
    agrees: np.ndarray
    lines: list[str]
    ends: np.ndarray
    at: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray


def aligned(tokenizers: TwoTokenizers, texts: list[str], whole: bool = True) -> Aligned:
    """Texts, each of which follows a blank. An empty one has no tokens if texts are whole ones;
    else it is a blank at the end of a longer text."""
    known = Numbers()
    numbers = [known.of(text) if text or not whole else [] for text in texts]
    units = aligned_units(tokenizers, known.texts)
    sizes = np.fromiter(map(len, numbers), np.int64, len(texts))
    flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
    of_text = np.repeat(np.arange(len(texts)), sizes)
    agrees = sizes > 0
    agrees[of_text[~units.agrees[flat]]] = False
    counts = [sums_by(of_text, c[flat], len(texts)) * agrees for c in units.counts]
    lines = [
        "".join([units.lines[n] for n in part])[:-1] if good else ""
        for part, good in zip(numbers, agrees)
    ]
    # Equal units of a text are merged before their pairs are listed.
    kept = agrees[of_text]
    span = max(1, len(units.lines))
    keys, often = np.unique(of_text[kept] * span + flat[kept], return_counts=True)
    text, unit = np.divmod(keys, span)
    each = units.pair_ends[unit + 1] - units.pair_ends[unit]
    places = expanded(units.pair_ends[unit], each)
    met = np.zeros(len(units.pairs), bool)
    met[places] = True
    pairs, number = np.unique(units.pairs[met], return_inverse=True)
    at = np.zeros(len(units.pairs), np.int64)
    at[met] = number
    span = max(1, len(pairs))
    keys = np.repeat(text, each) * span + at[places]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    weights = (units.weights[places] * np.repeat(often, each))[order]
    weights = np.add.reduceat(weights, firsts) if len(firsts) else weights
    text, at = np.divmod(keys[firsts], span)
    ends = np.searchsorted(text, np.arange(len(texts)), "right")
    return Aligned(np.array(counts).reshape(4, -1), agrees, lines, ends, at, weights, pairs)


# --- chunks of whole texts


def narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.min_scalar_type(most)).tobytes()


def widened(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // count}" if count else "u1").astype(np.int64)


class Tables:
    """The models, sent to the executors once and loaded once by each worker."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            models = (a.read(), b.read())
        if sum(map(len, models)) > MOST_MODEL_BYTES:
            raise ValueError("The tokenizer files are too large to send to every executor.")
        TwoTokenizers(*models)  # what does not fit is refused here, not in a task
        self.models = docs.sparkSession.sparkContext.broadcast(models)

    def tokenizers(self) -> TwoTokenizers:
        key = self.models.value
        if _kept.get("models") != key:
            _kept.update(models=key, tokenizers=TwoTokenizers(*key))
        return _kept["tokenizers"]


_kept: dict = {}


def align_texts(
    docs: DataFrame,
    text_col: str,
    a_path: str,
    b_path: str,
    keep: list[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    long_bytes: int = LONG_BYTES,
    piece_chars: int = PIECE_CHARS,
    fan: int = FAN,
) -> DataFrame:
    """`row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` of every document.

    An id pair's count is the number of documents that hold it linked. `n_best` counts the links
    whose count is the highest of their A id, `count_sum` adds the counts up over the links.
    `row` holds the kept columns (all by default). The tokenizer files are read by the driver.
    """
    tables = Tables(docs, a_path, b_path)
    rows = carried(docs, keep, text_col)
    size = F.octet_length("text")
    longest = rows.agg(F.max(size)).first()[0] or 0
    chunks = chunks_of(rows.where(size <= long_bytes), tables, chunk_bytes)
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "in_docs")).alias("p"))
    held = asked.select("chunk", F.col("p.pairs").alias("pair"), F.col("p.in_docs").alias("in_docs"))
    counts = held.select("pair", "in_docs")
    if longest > long_bytes:
        parts = 1 + (longest + 1) // piece_chars
        texts, pairs = long_texts(rows.where(size > long_bytes), tables, piece_chars, parts, fan)
        counts = counts.unionByName(pairs.select("pair", F.lit(1).alias("in_docs")))
    scores = scored(counts)
    found = chunk_results(chunks, held.select("chunk", "pair"), scores)
    if longest > long_bytes:
        found = found.unionByName(long_results(texts, pairs, scores))
    return found


def chunks_of(rows: DataFrame, tables: Tables, chunk_bytes: int) -> DataFrame:
    """One row per chunk: its documents, its pairs and how many of the documents hold each."""
    row = rows.schema["row"]
    doc = T.StructType([
        row, *[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("groups_sha256", T.StringType()),
    ])
    schema = T.StructType([
        T.StructField("chunk", T.LongType()),
        T.StructField("docs", T.ArrayType(doc)),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("in_docs", T.ArrayType(T.IntegerType())),
        *[T.StructField(n, T.BinaryType()) for n in ("ends", "at", "weights")],
    ])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number = tables.tokenizers(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                found = aligned(tokenizers, part.column("text").to_pylist())
                yield chunk_row(number, part.column("row"), found)
                number += 1

    return checkpointed(rows.mapInArrow(chunk, schema))


def chunk_row(number: int, row: pa.Array, found: Aligned) -> pa.RecordBatch:
    digests = [
        hashlib.sha256(line.encode()).hexdigest() if good else ""
        for line, good in zip(found.lines, found.agrees)
    ]
    docs = pa.StructArray.from_arrays(
        [row, *map(pa.array, found.counts), pa.array(digests)], ["row", *COUNTS, "groups_sha256"]
    )
    in_docs = np.bincount(found.at, minlength=len(found.pairs)).astype(np.int32)
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [
        pa.array([number]), whole(docs), whole(pa.array(found.pairs)), whole(pa.array(in_docs)),
        *[pa.array([narrow(v)], pa.binary()) for v in (found.ends, found.at, found.weights)],
    ]
    return pa.record_batch(columns, ["chunk", "docs", "pairs", "in_docs", "ends", "at", "weights"])


def scored(counts: DataFrame) -> DataFrame:
    """`pair, in_docs, best`: in how many documents a pair is linked, and whether no other pair of
    its A id is in more. An A id has at most as many pairs as B has ids."""
    total = counts.groupBy("pair").agg(F.sum("in_docs").alias("in_docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return total.withColumn("best", F.col("in_docs") == F.max("in_docs").over(of_a))


def chunk_results(chunks: DataFrame, held: DataFrame, scores: DataFrame) -> DataFrame:
    """Every chunk gets the scores of its own pairs back and sums them by document."""
    answers = held.join(scores, "pair").groupBy("chunk").agg(
        F.collect_list(F.struct("pair", "in_docs", "best")).alias("answers")
    )
    doc = chunks.schema["docs"].dataType.elementType
    names = [*COUNTS, "n_best", "count_sum"]
    schema = T.StructType([
        doc["row"], *[T.StructField(n, T.LongType()) for n in names], T.StructField("groups_sha256", T.StringType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, answers = batch.column("docs")[i].values, batch.column("answers")[i].values
                ends, at, weights = (batch.column(n)[i].as_py() for n in ("ends", "at", "weights"))
                ends = widened(ends, len(docs))
                total = int(ends[-1]) if len(ends) else 0
                at, weights = widened(at, total), widened(weights, total)
                best, sums = np.zeros(total, np.int64), np.zeros(total, np.int64)
                if total:
                    # The chunk's pairs are sorted and every one is answered.
                    order = np.argsort(answers.field("pair").to_numpy(), kind="stable")
                    best = answers.field("best").to_numpy(zero_copy_only=False)[order][at] * weights
                    sums = answers.field("in_docs").to_numpy()[order][at] * weights
                texts = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
                more = [sums_by(texts, values, len(docs)) for values in (best, sums)]
                columns = [docs.field(n) for n in ("row", *COUNTS)]
                yield pa.record_batch([*columns, *map(pa.array, more), docs.field("groups_sha256")],
                                      ["row", *names, "groups_sha256"])

    return chunks.drop("pairs", "in_docs").join(answers, "chunk", "left").drop("chunk").mapInArrow(score, schema)


def sums_by(group: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of whole numbers by group, exact in 64 bits."""
    out = np.zeros(count, np.int64)
    np.add.at(out, group, values)
    return out


# --- long texts, piece by piece


def long_texts(
    rows: DataFrame, tables: Tables, piece_chars: int, parts: int, fan: int
) -> tuple[DataFrame, DataFrame]:
    """Long texts with their counts, and their distinct pairs with the number of links of each."""
    pieces = checkpointed(pieces_of(rows, piece_chars))
    segments = checkpointed(closed_segments(pieces.drop("row"), parts, fan))
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("place", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("agrees", T.BooleanType()),
        T.StructField("line", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.LongType())),
    ])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tables.tokenizers()
        for batch in batches:
            for i in range(batch.num_rows):
                doc, place, text = (batch.column(n)[i].as_py() for n in ("doc", "place", "text"))
                found = aligned(tokenizers, [text[1:]], whole=False)
                yield pa.record_batch([
                    pa.array([doc]), pa.array([place]), *map(pa.array, found.counts), pa.array(found.agrees),
                    pa.array(found.lines), pa.array([found.pairs]), pa.array([found.weights]),
                ], schema.names)

    parts_done = checkpointed(
        segments.repartition(shuffle_partitions(rows.sparkSession), "doc", "place").mapInArrow(align, schema)
    )
    sums = parts_done.groupBy("doc").agg(
        *[F.sum(n).alias(n) for n in COUNTS], F.every("agrees").alias("agrees")
    )
    lines = parts_done.select("doc", "place", "line").repartition("doc").sortWithinPartitions("doc", "place")
    texts = (
        pieces.where("part = 0").select("doc", "row")
        .join(sums, "doc").join(lines.mapInArrow(line_digests, "doc long, groups_sha256 string"), "doc")
    )
    agree = sums.where("agrees").select("doc")
    zipped = F.explode(F.arrays_zip("pairs", "weights")).alias("p")
    pairs = (
        parts_done.join(agree, "doc").select("doc", zipped)
        .groupBy("doc", F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("weight"))
    )
    return texts, checkpointed(pairs)


def pieces_of(rows: DataFrame, piece_chars: int) -> DataFrame:
    """`doc, part, piece, row`: pieces of a blank and the text; the row stands at the first one."""
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("part", T.LongType()),
        T.StructField("piece", T.StringType()), T.StructField("row", rows.schema["row"].dataType),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(batch.num_rows):
                text = " " + batch.column("text")[i].as_py()
                row = batch.column("row").slice(i, 1)
                for part, start in enumerate(range(0, len(text), piece_chars)):
                    piece = text[start : start + piece_chars]
                    yield pa.record_batch(
                        [pa.array([doc]), pa.array([part]), pa.array([piece]),
                         row if part == 0 else pa.nulls(1, row.type)], schema.names,
                    )
                doc += 1

    return rows.mapInArrow(cut, schema)


def closed_segments(pieces: DataFrame, parts: int, fan: int) -> DataFrame:
    """`doc, place, text`: the closed text of all pieces and of what lies between them, in the order
    of `place`; every text begins with a blank and ends at a certain cut or with the document.

    Fragments are composed `fan` neighbours at a time; a level divides their number by `fan`.
    """
    kind = "doc long, part long, place long, text string, prefix string, closed boolean, suffix string"
    n = shuffle_partitions(pieces.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, piece in zip(*[batch.column(c).to_pylist() for c in ("doc", "part", "piece")]):
                fragment, between = fragment_of(piece)
                yield fragment_row(doc, part, 2 * part + 1, between, fragment)

    level = pieces.select("doc", "part", "piece").repartition(n, "doc", "part").mapInArrow(cut, kind)
    level = checkpointed(level)
    closed = level.where("text <> ''").select("doc", "place", "text")
    scale = 1  # pieces in a fragment
    fragments = level.select("doc", "part", "prefix", "closed", "suffix")
    while parts > 1:
        grouped = fragments.withColumn("group", F.floor(F.col("part") / fan)).repartition(n, "doc", "group")
        grouped = grouped.sortWithinPartitions("doc", "group", "part")
        level = checkpointed(grouped.mapInArrow(composer(scale), kind))
        closed = closed.unionByName(level.where("text <> ''").select("doc", "place", "text"))
        fragments = level.where("part IS NOT NULL").select("doc", "part", "prefix", "closed", "suffix")
        parts = -(-parts // fan)
        scale *= fan
    last = F.lit(2**62).alias("place")
    ends = fragments.select("doc", F.lit(0).cast("long").alias("place"), F.col("prefix").alias("text")).unionByName(
        fragments.where("closed").select("doc", last, F.col("suffix").alias("text"))
    )
    return closed.unionByName(ends)


def composer(scale: int):
    """A function over sorted rows that composes the fragments of every group, one at a time.

    What becomes closed before the fragment `part` lies before the piece part x scale.
    """

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fragment = None, EMPTY
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc", "group", "part", "prefix", "closed", "suffix")]
            for doc, group, part, *fields in zip(*columns):
                if (doc, group) != key:
                    if key is not None:
                        yield fragment_row(*key, 0, "", fragment)
                    key, fragment = (doc, group), EMPTY
                fragment, between = composed(fragment, Fragment(*fields))
                if between:
                    yield fragment_row(doc, None, 2 * part * scale, between, None)
        if key is not None:
            yield fragment_row(*key, 0, "", fragment)

    return compose


def fragment_row(doc: int, part: int | None, place: int, text: str, fragment: Fragment | None) -> pa.RecordBatch:
    own = [None] * 3 if fragment is None else [fragment.prefix, fragment.closed, fragment.suffix]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    values = [doc, part, place, text, *own]
    names = ["doc", "part", "place", "text", "prefix", "closed", "suffix"]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names)


def line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every document's groups, from sorted rows, one line in memory at a time."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key]), pa.array([digest.hexdigest()])], ["doc", "groups_sha256"])

    for batch in batches:
        for doc, line in zip(*[batch.column(c).to_pylist() for c in ("doc", "line")]):
            if doc != key:
                if key is not None:
                    yield done()
                key, digest = doc, hashlib.sha256()
            else:
                digest.update(b";")
            digest.update(line.encode())
    if key is not None:
        yield done()


def long_results(texts: DataFrame, pairs: DataFrame, scores: DataFrame) -> DataFrame:
    best = F.sum(F.when(F.col("best"), F.col("weight")).otherwise(0)).alias("n_best")
    sums = pairs.join(scores, "pair").groupBy("doc").agg(
        best, F.sum(F.col("weight") * F.col("in_docs")).alias("count_sum")
    )
    zero = lambda name: F.when(F.col("agrees"), F.coalesce(name, F.lit(0))).otherwise(0).alias(name)
    return texts.join(sums, "doc", "left").select(
        "row", *[zero(n) for n in (*COUNTS, "n_best", "count_sum")],
        F.when(F.col("agrees"), F.col("groups_sha256")).otherwise("").alias("groups_sha256"),
    )
