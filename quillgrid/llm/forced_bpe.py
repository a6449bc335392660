"""Byte-pair encoding with forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be merged
over, so it marks a certain cut. A word is cut there, its fragments are encoded independently
and their ids are put together. Fragments are short and repeat, so most come from a cache.

The tokenizer is read from a file of the public `tokenizers` format: byte-level symbols, an end
of word suffix, lower case, white space dropped, special tokens found in the text as such.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import carried, slices

#: The tokenizer file is broadcast; a larger one is refused.
MOST_FILE_BYTES = 64 << 20
#: Words and fragments that one task remembers before it starts anew.
CACHE_WORDS = 200_000
#: Fragments up to this size are merged without a queue.
FEW_SYMBOLS = 32
NEVER = 1 << 60
#: Longer words are encoded but not remembered.
CACHE_LENGTH = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, extra = [""] * 256, 0
    for byte in range(256):
        if byte in printable:
            symbols[byte] = chr(byte)
        else:
            symbols[byte] = chr(256 + extra)
            extra += 1
    return symbols


class Remembered(dict):
    """Packed words by word; a missing one is encoded, and kept unless it is very long."""

    def __init__(self, encode: Callable[[str], tuple[bytes, str]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[bytes, str]:
        found = self.encode(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class ForcedBpe:
    """Encoder and decoder over one parsed tokenizer file."""

    def __init__(self, source: bytes) -> None:
        import regex

        parsed = json.loads(source)
        model = parsed["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.tokens = {i: token for token, i in self.vocabulary.items()}
        self.specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.tokens.update({i: content for content, i in self.specials.items()})
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.inside = self._inside_pairs()
        self.symbols = byte_symbols()
        rules = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(rules)
        self.special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len)[::-1]) + ")"
        )
        self.packed = Remembered(self._pack)
        self.fragments: dict[tuple[str, ...], list[str]] = {}

    def _inside_pairs(self) -> set[tuple[str, str]]:
        """Every pair of neighbouring symbols inside some token."""
        found = set()
        for token in self.vocabulary:
            ended = bool(self.suffix) and token.endswith(self.suffix)
            bare = token[: -len(self.suffix)] if ended else token
            symbols = list(bare)
            if ended and symbols:
                symbols[-1] += self.suffix
            found.update(zip(symbols, symbols[1:]))
        return found

    def normal(self, text: str) -> str:
        """Composed and in lower case character by character.

        White space is in no word, so it may stay as it is.
        """
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma

    def cut(self, symbols: list[str]) -> list[list[str]]:
        """The symbols of a word, split at every pair that no token has inside."""
        pieces, start = [], 0
        for i, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in self.inside:
                pieces.append(symbols[start:i])
                start = i
        pieces.append(symbols[start:])
        return pieces

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, then from the left: by looking for the best pair if there are few."""
        if len(symbols) > FEW_SYMBOLS:
            return self.merge_many(symbols)
        symbols, rank_of = list(symbols), self.ranks.get
        ranks = [rank_of(pair, NEVER) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((symbols[i - 1], symbols[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank_of((symbols[i], symbols[i + 1]), NEVER)
        return symbols

    def merge_many(self, symbols: list[str]) -> list[str]:
        """The same with a queue of pairs over a linked list."""
        count = len(symbols)
        symbols, after, before = list(symbols), list(range(1, count + 1)), list(range(-1, count - 1))
        queue = [
            (rank, i, pair)
            for i, pair in enumerate(zip(symbols, symbols[1:]))
            if (rank := self.ranks.get(pair)) is not None
        ]
        heapq.heapify(queue)
        while queue:
            _, i, (left, right) = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= count or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < count:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < count:
                    pair = (symbols[a], symbols[b])
                    if (rank := self.ranks.get(pair)) is not None:
                        heapq.heappush(queue, (rank, a, pair))
        return [s for s in symbols if s]

    def word(self, word: str) -> list[str]:
        """The tokens of one word."""
        symbols = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        tokens: list[str] = []
        for piece in self.cut(symbols):
            key = tuple(piece)
            merged = self.fragments.get(key)
            if merged is None:
                merged = self.merge(piece) if len(piece) > 1 else piece
                if len(piece) <= CACHE_LENGTH:
                    if len(self.fragments) >= CACHE_WORDS:
                        self.fragments.clear()
                    self.fragments[key] = merged
            tokens += merged
        return tokens

    def _pack(self, word: str) -> tuple[bytes, str]:
        tokens = self.word(word)
        return b"".join([self.vocabulary[t].to_bytes(4, "little") for t in tokens]), " ".join(tokens)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their tokens joined by spaces."""
        found: list[tuple[bytes, str]] = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.specials:
                found.append((self.specials[part].to_bytes(4, "little"), part))
            else:
                found += map(self.packed.__getitem__, self.words.findall(self.normal(part)))
        return b"".join([ids for ids, _ in found]), " ".join([tokens for _, tokens in found])

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids joined by spaces: what a file without a decoder asks for."""
        return " ".join(self.tokens[i] for i in ids)


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as file:
        source = file.read(MOST_FILE_BYTES + 1)
    if len(source) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return source


def encode_texts(
    df: DataFrame, text_col: str, tokenizer: str, keep: list[str] | None = None,
    ids: bool = True, digests: bool = False,
) -> DataFrame:
    """`row` (the kept columns), n_tokens and, as asked for, `ids` or digests.

    `tokenizer` is a file on the driver, sent to the tasks. Missing texts are empty, and empty
    texts have no tokens; texts of any length are encoded whole. Repeated rows stay, other
    columns pass in `row`, and an empty table gives an empty result. `ids_sha256` is that of the
    ids as little-endian 32-bit integers, `decoded_sha256` that of the text decoded from them.
    """
    source = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    rows = carried(df, keep, text_col)
    kind = rows.schema["row"].dataType.simpleString()
    extra = [("ids", "array<int>", pa.list_(pa.int32()))] * ids
    if digests:
        extra += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    schema = ", ".join([f"row {kind}", "n_tokens long", *(f"{n} {t}" for n, t, _ in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = ForcedBpe(source.value)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                encoded, columns = [], {}
                hashes: list[tuple[str, str]] = []
                for text in part.column("text"):
                    packed, tokens = bpe.encode(text.as_py())
                    encoded.append(packed if ids else len(packed))
                    if digests:
                        hashes.append(
                            (hashlib.sha256(packed).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest())
                        )
                counts = [len(p) if ids else p for p in encoded]
                columns["n_tokens"] = pa.array([n // 4 for n in counts], pa.int64())
                if ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]) // 4
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()),
                        pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32()),
                    )
                if digests:
                    columns["ids_sha256"] = pa.array([h for h, _ in hashes], pa.string())
                    columns["decoded_sha256"] = pa.array([h for _, h in hashes], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *columns.values()], ["row", *columns]
                )

    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids_col: str, tokenizer: str) -> DataFrame:
    """All columns as `row`, and `decoded`: the text of the ids; missing ids are no ids."""
    source = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBpe(source.value)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string())], ["row", "decoded"]
            )

    return rows.mapInArrow(run, f"row {kind}, decoded string")


