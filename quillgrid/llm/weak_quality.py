"""Document quality from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-
maximisation over the counts of all vote patterns estimates how accurate each labeller is and
how likely each pattern's documents are good. These posterior labels train a linear scorer on
hashed shapes of words, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import carried, slices, span_hashes, text_buffer, word_spans

#: Distinct texts that the scorer is fitted on, drawn by a hash of the text.
SAMPLE = 4000
#: Longer texts are judged whole but not drawn, which bounds the sample's bytes.
LONGEST_SAMPLED = 32_768
SLOTS = 1 << 12
SLICE_BYTES = 1 << 20
EM_ROUNDS = 200
BAD, NONE, GOOD = 0, 1, 2

# Fixed values of the labellers: (measure, vote good from, vote bad from); None never votes so.
# Most can only find fault; a text without that fault is no better for it.
LABELLERS = [
    ("symbols_per_word", None, 0.9),
    ("upper_share", None, 0.6),
    ("repeated_neighbours", None, 0.2),
    ("top_word_share", None, 0.3),
    ("decorated_words", None, 0.3),
    ("lone_symbols", None, 0.2),
    ("repeated_shingles", None, 0.3),
    ("odd_words", None, 0.4),
    ("plain_words", 0.9, None),
    ("fresh_words", 0.9, None),
]
#: Measures of repetition need some words to say anything.
LEAST_WORDS = 8

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PLAIN = np.zeros(256, bool)
PLAIN[[ord(c) for c in ".,;:?'\"-()"]] = True
SYMBOL = ~(SPACE | LETTER | DIGIT | PLAIN)
#: Bytes as classes: letters of either case, digits, and all else as itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[LETTER] = ord("a")
SHAPE[UPPER] = ord("A")
SHAPE[DIGIT] = ord("0")


def per_span(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[stops] - total[starts]


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (text x labeller), and the hashed features of all texts as text and slot numbers.

    Words end at ASCII white space. A text without words gets no votes and no features.
    """
    raw, offsets = text_buffer(texts)
    count = len(texts)
    starts, stops, owner = word_spans(~SPACE[raw], offsets)
    words = np.bincount(owner, minlength=count)
    some = np.maximum(words, 1)
    symbols = per_span(SYMBOL[raw], starts, stops)
    uppers = per_span(UPPER[raw], starts, stops)
    letters = per_span(LETTER[raw], starts, stops)
    hashes = span_hashes(raw, starts, stops)

    def mean(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flags, minlength=count) / some

    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    by_word = np.lexsort((hashes, owner))
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(hashes[by_word]) != 0) | (np.diff(owner[by_word]) != 0)
    heads = np.flatnonzero(new)
    top = np.zeros(count)
    np.maximum.at(top, owner[by_word][heads], np.diff(np.append(heads, len(starts))))
    triple = np.zeros(len(starts), bool)
    if len(starts) > 2:
        threes = hashes[:-2] * np.uint64(31) ^ hashes[1:-1] * np.uint64(1009) ^ hashes[2:]
        whole = owner[2:] == owner[:-2]
        order = np.lexsort((threes, owner[:-2]))
        order = order[whole[order]]
        again = np.zeros(len(order), bool)
        again[1:] = (threes[order][1:] == threes[order][:-1]) & (
            owner[order][1:] == owner[order][:-1]
        )
        triple[order[again]] = True
    size = np.bincount(owner, weights=letters, minlength=count)
    plain = (symbols == 0) & (letters > 0) & ((uppers <= 1) | (uppers * 2 < letters))
    values = {
        "odd_words": mean(~plain),
        "plain_words": mean(plain),
        "fresh_words": 1 - mean(same | triple),
        "symbols_per_word": mean(symbols),
        "upper_share": np.bincount(owner, weights=uppers, minlength=count) / np.maximum(size, 1),
        "repeated_neighbours": mean(same),
        "top_word_share": top / some,
        "decorated_words": mean((symbols >= 2) & (letters > 0)),
        "lone_symbols": mean((symbols > 0) & (letters == 0)),
        "repeated_shingles": mean(triple),
    }
    votes = np.full((count, len(LABELLERS)), NONE, np.int8)
    for i, (name, good, bad) in enumerate(LABELLERS):
        if good is not None:
            votes[values[name] >= good, i] = GOOD
        if bad is not None:
            votes[values[name] >= bad, i] = BAD
        if name in ("repeated_neighbours", "top_word_share", "repeated_shingles"):
            votes[words < LEAST_WORDS, i] = NONE
    votes[words == 0] = NONE
    return votes, *hashed_shapes(raw, starts, stops, owner, same)


def hashed_shapes(
    raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, owner: np.ndarray, same: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of the shape of each word, of each pair of shapes and of each repeat."""
    classes = SHAPE[raw]
    first = np.zeros(len(raw), bool)
    first[starts] = True
    inside = ~SPACE[raw]
    stays = inside.copy()
    stays[1:] &= (classes[1:] != classes[:-1]) | first[1:]
    short = classes[stays]
    place = np.concatenate([[0], np.cumsum(stays)])
    shape = span_hashes(short, place[starts], place[stops])
    pair = shape.copy()
    pair[1:] = shape[1:] ^ (shape[:-1] * np.uint64(0x9E3779B97F4A7C15))
    pair ^= np.uint64(0x5851F42D4C957F2D)
    joined = np.concatenate([shape, pair, (same.astype(np.uint64) + np.uint64(7)) << np.uint64(33)])
    slot = ((joined ^ (joined >> np.uint64(29))) % np.uint64(SLOTS)).astype(np.int64)
    return np.tile(owner, 3), slot


def feature_rows(texts: int, owner: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, slot and value of the distinct features: logged counts at length one per text."""
    keys, counts = np.unique(owner * SLOTS + slot, return_counts=True)
    row, column = np.divmod(keys, SLOTS)
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=texts))
    return row, column, value / norm[row]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Accuracies (class x labeller x vote), the share of good documents, P(good) per pattern.

    Starts at whether any labeller found fault. Every labeller is taken to vote on its own given the class;
    a little smoothing keeps all rates above zero.
    """
    weight = counts.astype(float)
    lead = (patterns == GOOD).any(1) * 1.0 - 2 * (patterns == BAD).any(1)
    posterior = np.where(lead > 0, 0.9, np.where(lead < 0, 0.1, 0.5))
    labellers = patterns.shape[1]
    for _ in range(EM_ROUNDS):
        share = (weight @ posterior + 1) / (weight.sum() + 2)
        rates = np.empty((2, labellers, 3))
        for vote in (BAD, NONE, GOOD):
            hit = (patterns == vote) * weight[:, None]
            rates[1, :, vote] = posterior @ hit + 1
            rates[0, :, vote] = (1 - posterior) @ hit + 1
        rates /= rates.sum(2, keepdims=True)
        logs = np.log(rates[:, np.arange(labellers), patterns]).sum(2)
        odds = np.log(share / (1 - share)) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return rates, share, posterior


def fit_scorer(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray
) -> np.ndarray:
    """Logistic weights (the last one constant) by adaptive gradient ascent."""
    weights = np.zeros(SLOTS + 1)
    norm = np.full(SLOTS + 1, 1e-6)
    for _ in range(300 if len(target) else 0):
        odds = np.bincount(row, weights=value * weights[column], minlength=len(target)) + weights[-1]
        gap = (target - 1 / (1 + np.exp(-np.clip(odds, -50, 50)))) / len(target)
        slope = np.append(np.bincount(column, weights=value * gap[row], minlength=SLOTS), gap.sum())
        slope[:-1] -= 1e-4 * weights[:-1]
        norm += slope**2
        weights += 0.5 * slope / np.sqrt(norm)
    return weights


def votes_of(df: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    """`row`, `text_hash` and `votes`, a digit of 0 (bad), 1 (nothing), 2 (good) per labeller."""
    rows = carried(df, keep, text_col)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                votes, _, _ = measures(part.column("text"))
                digits = [bytes(v + 48).decode() for v in votes]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(digits, pa.string())], ["row", "votes"]
                )

    return rows.mapInArrow(run, f"row {kind}, votes string")


def fit(df: DataFrame, text_col: str, sample: int = SAMPLE) -> dict:
    """The labellers' accuracies and the scorer, from vote counts of all documents."""
    patterns = votes_of(df, text_col, []).groupBy("votes").agg(F.count("*").alias("n")).collect()
    table = np.array([[int(c) for c in r["votes"]] for r in patterns], np.int64)
    counts = np.array([r["n"] for r in patterns], np.int64)
    if not len(counts):
        return {"posterior": {}, "weights": np.zeros(SLOTS + 1), "rates": None, "share": None}
    rates, share, posterior = estimate(table, counts)
    by_votes = {r["votes"]: float(p) for r, p in zip(patterns, posterior)}
    # About `sample` distinct texts, by a hash of the text: the same ones at any partitioning.
    bound = min(int(sample / counts.sum() * 2.0**63), (1 << 63) - 1)
    text = F.col(f"`{text_col}`").cast("string")
    mark = F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1))
    drawn = (
        df.where(text.isNotNull() & (F.octet_length(text) <= LONGEST_SAMPLED) & (mark <= bound))
        .select(mark.alias("mark"), text.alias("text"))
        .groupBy("mark").agg(F.min("text").alias("text"))
        .orderBy("mark").limit(2 * sample).collect()
    )
    parts, target = [], []
    for first in range(0, len(drawn), 200):  # a few texts at a time: their measures take memory
        some = drawn[first : first + 200]
        votes, owner, slot = measures(pa.array([r["text"] for r in some], pa.string()))
        target += [by_votes.get(bytes(v + 48).decode(), share) for v in votes]
        row, column, value = feature_rows(len(some), owner, slot)
        parts.append((row + first, column, value))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    row, column, value = (np.concatenate(c) for c in zip(none, *parts))
    weights = fit_scorer(row, column, value, np.array(target))
    return {"posterior": by_votes, "weights": weights, "rates": rates, "share": share}


def quality(
    df: DataFrame, text_col: str, keep: list[str] | None = None, sample: int = SAMPLE,
    threshold: float = 0.5,
) -> DataFrame:
    """`row` (the kept columns), `votes`, `posterior`, `score` and `accepted`.

    `votes` has a digit for each of LABELLERS, `posterior` is the probability of a good document
    given the votes alone, `score` that of the scorer, and `accepted` says whether the score is
    at least `threshold`.

    Missing, empty and blank texts have no votes; they score 0 and are rejected. Accuracies come
    from the votes on all documents; only the scorer is fitted on a sample, of some `sample`
    distinct texts of at most LONGEST_SAMPLED bytes. Texts of any length are judged whole, and
    equal texts get equal scores. Other columns pass in `row`, and an empty table gives an empty
    result.
    """
    model = fit(df, text_col, sample)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    rows = carried(df, keep, text_col)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights = shipped.value["posterior"], shipped.value["weights"]
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                votes, owner, slot = measures(part.column("text"))
                digits = [bytes(v + 48).decode() for v in votes]
                row, column, value = feature_rows(part.num_rows, owner, slot)
                odds = np.bincount(row, weights=value * weights[column], minlength=part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(odds + weights[-1], -50, 50)))
                score[np.bincount(owner, minlength=part.num_rows) == 0] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), pa.array(digits, pa.string()),
                        pa.array([posterior.get(d, 0.5) for d in digits], pa.float64()),
                        pa.array(score), pa.array(score >= threshold),
                    ],
                    ["row", "votes", "posterior", "score", "accepted"],
                )

    return rows.mapInArrow(
        run, f"row {kind}, votes string, posterior double, score double, accepted boolean"
    )
