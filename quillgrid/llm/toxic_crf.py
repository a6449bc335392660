"""Toxic spans by a linear-chain conditional random field.

Documents are labelled as wholes, so tokens get their labels first: beginnings of words that are
much more frequent in toxic than in clean training texts (a likelihood-ratio test over all of
them) mark the tokens of toxic texts. A two-state chain with hashed word features is fitted to a
bounded sample of these tagged texts by maximum likelihood; the gradients are summed over parts
of the sample, which stay in the executors. Forward-backward marginals of a text then give its offending
offsets, and their maximum and sum, calibrated on the training labels, its score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import carried, checkpointed, slices, span_hashes, text_buffer, word_spans

#: Labelled training texts of either class, drawn by a hash of the text, equal ones once.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 3000
#: Parts of the sample, each with its share of the gradients.
PARTS = 16
#: Longer texts are counted and scored whole but not drawn, which bounds the sample's bytes.
LONGEST_SAMPLED = 32_768
#: Likelihood ratio (G squared) from which a word beginning marks tokens, and its least support.
LEAST_RATIO, LEAST_DOCUMENTS = 24.0, 3
#: How many times more frequent it has to be in toxic documents.
LEAST_LIFT = 4
#: Bytes of a word's beginning that are features; 0 stands for the whole word.
PREFIXES = (0, 3, 4, 5, 6, 7, 8)
SLOTS = 1 << 18
ROUNDS, RATE, DECAY = 25, 0.6, 1e-6
SEGMENT = 128
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


@dataclass
class Tokens:
    """The words of some texts: features of the distinct ones, and the words by number."""

    starts: np.ndarray
    stops: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    features: np.ndarray  # distinct word x hashed feature
    raw: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    starts, stops, owner = word_spans(WORD[raw], offsets)
    whole = span_hashes(raw, starts, stops)
    distinct, example, number = np.unique(whole, return_index=True, return_inverse=True)
    columns = [distinct]
    for size in PREFIXES[1:]:
        end = np.minimum(starts[example] + size, stops[example])
        columns.append(span_hashes(raw, starts[example], end) + np.uint64(size))
    features = np.stack(columns, 1) if len(distinct) else np.zeros((0, len(PREFIXES)), np.uint64)
    return Tokens(starts, stops, owner, number, features, raw)


def slots(features: np.ndarray) -> np.ndarray:
    return ((features ^ (features >> np.uint64(40))) % np.uint64(SLOTS)).astype(np.int64)


class Chain:
    """Marginals of two-state chains, many at once, with cost linear in the number of tokens.

    Texts are cut into segments. All segments go in step to get their transfer matrices, these
    are chained text by text, and a second pass in step fills in the places between.
    State 0 has score 0 everywhere, and a virtual token in state 0 stands before each text.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts[counts > 0]
        per_text = (self.counts + SEGMENT - 1) // SEGMENT
        self.first = np.cumsum(per_text) - per_text
        self.per_text = per_text
        total = int(per_text.sum())
        nth = np.arange(total) - np.repeat(self.first, per_text)
        length = np.minimum(np.repeat(self.counts, per_text) - nth * SEGMENT, SEGMENT)
        self.by_length = np.argsort(-length, kind="stable")
        self.place = np.empty(total, np.int64)
        self.place[self.by_length] = np.arange(total)
        self.length = length[self.by_length]
        start = np.repeat(np.cumsum(self.counts) - self.counts, per_text) + nth * SEGMENT
        self.start = start[self.by_length]
        self.active = [int(np.searchsorted(-self.length, -t, "left")) for t in range(SEGMENT)]
        self.texts = np.argsort(-per_text, kind="stable")
        self.total = int(self.counts.sum())

    def marginals(self, scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(state 1) of every token, expected moves between states, and the log partition sum."""
        segments = len(self.length)
        if not segments:
            return np.zeros(0), np.zeros((2, 2)), 0.0
        factor = np.exp(np.clip(scores, -30, 30))
        step = np.exp(move)
        matrix = np.tile(np.eye(2), (segments, 1, 1))
        scale = np.zeros(segments)
        for t in range(SEGMENT):
            n = self.active[t]
            if not n:
                break
            matrix[:n] = matrix[:n] @ step
            matrix[:n, :, 1] *= factor[self.start[:n] + t][:, None]
            norm = matrix[:n].sum((1, 2))
            matrix[:n] /= norm[:, None, None]
            scale[:n] += np.log(norm)
        forward = np.zeros((segments, 2))
        backward = np.ones((segments, 2))
        logs = 0.0
        state = np.tile([1.0, 0.0], (len(self.counts), 1))
        tail = np.ones((len(self.counts), 2))
        sizes = -self.per_text[self.texts]
        for k in range(int(self.per_text.max())):
            texts = self.texts[: int(np.searchsorted(sizes, -k, "left"))]
            at = self.place[self.first[texts] + k]
            forward[at] = state[texts]
            moved = np.einsum("ni,nij->nj", state[texts], matrix[at])
            norm = moved.sum(1)
            state[texts] = moved / norm[:, None]
            logs += float(np.log(norm).sum() + scale[at].sum())
        for k in range(int(self.per_text.max()) - 1, -1, -1):
            texts = self.texts[: int(np.searchsorted(sizes, -k, "left"))]
            at = self.place[self.first[texts] + k]
            backward[at] = tail[texts]
            moved = np.einsum("nij,nj->ni", matrix[at], tail[texts])
            tail[texts] = moved / moved.sum(1)[:, None]
        ahead = np.zeros((SEGMENT + 1, segments, 2))
        ahead[0] = forward
        for t in range(SEGMENT):
            n = self.active[t]
            if not n:
                break
            row = ahead[t, :n] @ step
            row[:, 1] *= factor[self.start[:n] + t]
            ahead[t + 1, :n] = row / row.sum(1)[:, None]
        result = np.empty(self.total)
        moves = np.zeros((2, 2))
        behind = backward
        for t in range(SEGMENT - 1, -1, -1):
            n = self.active[t]
            if not n:
                continue
            both = ahead[t + 1, :n] * behind[:n]
            result[self.start[:n] + t] = both[:, 1] / both.sum(1)
            weighted = behind[:n].copy()
            weighted[:, 1] *= factor[self.start[:n] + t]
            pair = ahead[t, :n, :, None] * step[None] * weighted[:, None, :]
            moves += (pair / pair.sum((1, 2))[:, None, None]).sum(0)
            previous = weighted @ step.T
            behind[:n] = previous / previous.sum(1)[:, None]
        return result, moves, logs


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    calibration: np.ndarray


def emission(model_weights: np.ndarray, found: Tokens) -> np.ndarray:
    return model_weights[slots(found.features)].sum(1)[found.number]


def counted_beginnings(texts: DataFrame) -> DataFrame:
    """`feature`, `bad` and `good`: how many toxic and how many clean texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = tokens(part.column("text"))
                sides = [part.column(c).to_numpy() for c in ("toxic", "clean")]
                words = np.int64(len(found.features) or 1)
                document, word = np.divmod(np.unique(found.owner * words + found.number), words)
                for column in range(found.features.shape[1]):  # one kind at a time bounds the memory
                    feature, number = np.unique(found.features[:, column], return_inverse=True)
                    size = np.int64(len(feature) or 1)
                    owner, at = np.divmod(np.unique(document * size + number[word]), size)
                    counts = [
                        np.bincount(at, weights=side[owner], minlength=len(feature)).astype(np.int64)
                        for side in sides
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(feature.view(np.int64)), *map(pa.array, counts)],
                        ["feature", "bad", "good"],
                    )

    counted = texts.mapInArrow(run, "feature long, bad long, good long")
    return counted.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def telling_beginnings(counted: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Features that a likelihood-ratio test finds much more frequent in toxic than in clean texts."""
    bad, good = F.col("bad"), F.col("good")
    share = (bad + good) / (toxic + clean)
    part = bad * F.log(bad / (toxic * share)) + F.when(
        good > 0, good * F.log(good / (clean * share))
    ).otherwise(0)
    more = bad / toxic > LEAST_LIFT * good / clean
    telling = counted.where((bad >= LEAST_DOCUMENTS) & more & (2 * part >= LEAST_RATIO))
    return np.array([r["feature"] for r in telling.select("feature").collect()], np.int64)


def token_labels(found: Tokens, labels: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents that have a telling beginning."""
    marked = np.isin(found.features.view(np.int64), telling).any(1)
    return marked[found.number] & (labels[found.owner] == 1)


PIECE = {"features": np.int32, "number": np.int32, "tags": np.int8, "counts": np.int32, "labels": np.int8}


def tagged_pieces(sample: DataFrame, telling: np.ndarray) -> DataFrame:
    """The words, tags and labels of the sample, one row for each part of it."""
    shipped = sample.sparkSession.sparkContext.broadcast(telling)

    def piece(table: pa.Table) -> pa.Table:
        table = table.sort_by([("digest", "ascending"), ("label", "ascending")])
        labels = table["label"].to_numpy().astype(np.int64)
        found = tokens(table["text"])
        values = {
            "features": slots(found.features), "number": found.number, "labels": labels,
            "tags": token_labels(found, labels, shipped.value),
            "counts": np.bincount(found.owner, minlength=len(labels)),
        }
        columns = [pa.array([values[c].astype(kind).tobytes()], pa.binary()) for c, kind in PIECE.items()]
        return pa.table([table["part"].slice(0, 1), *columns], ["part", *PIECE])

    part = F.pmod(F.xxhash64("digest"), F.lit(PARTS))
    schema = ", ".join(["part long", *[f"{c} binary" for c in PIECE]])
    pieces = sample.withColumn("part", part).groupBy("part").applyInArrow(piece, schema)
    return checkpointed(pieces.coalesce(PARTS))


class Piece:
    """One row of `tagged_pieces`, in an executor."""

    def __init__(self, row: dict) -> None:
        values = {c: np.frombuffer(row[c], kind).astype(np.int64) for c, kind in PIECE.items()}
        self.features = values["features"].reshape(-1, len(PREFIXES))
        self.number, self.tags = values["number"], values["tags"]
        self.counts, self.labels = values["counts"], values["labels"]

    def marginals(self, weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = weights[self.features].sum(1)[self.number]
        return Chain(self.counts).marginals(scores, move)[:2]

    def slopes(self, weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the tags have more than the chain expects: of each slot, and of each move."""
        marginals, moves = self.marginals(weights, move)
        before = np.zeros(len(self.tags), np.int64)
        before[1:] = self.tags[:-1]
        before[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = 0
        seen = np.bincount(before * 2 + self.tags, minlength=4).reshape(2, 2)
        gap = np.bincount(self.number, self.tags - marginals, minlength=len(self.features))
        slope = np.zeros(SLOTS)
        for column in range(self.features.shape[1]):
            slope += np.bincount(self.features[:, column], weights=gap, minlength=SLOTS)
        return slope, seen - moves

    def inputs(self, weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the calibration sees of each text, and the labels."""
        marginals, _ = self.marginals(weights, move)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        return summary(marginals, owner, len(self.counts)), self.labels.astype(float)


def of_pieces(
    pieces: DataFrame, what: Callable, weights: np.ndarray, move: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two arrays that `what` makes of each piece, in the order of the parts."""
    used = np.flatnonzero(weights)
    shipped = pieces.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used], move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, move = shipped.value
        weights = np.zeros(SLOTS)
        weights[used] = values
        for batch in batches:
            for nth in range(batch.num_rows):
                row = batch.slice(nth, 1).to_pylist()[0]
                first, second = what(Piece(row), weights, move)
                first = first.ravel()
                some = np.flatnonzero(first)
                yield pa.RecordBatch.from_pydict({
                    "part": [row["part"]], "size": [first.size], "at": [some.astype(np.int32).tobytes()],
                    "first": [first[some].tobytes()], "second": [second.tobytes()],
                })

    schema = "part long, size long, at binary, first binary, second binary"
    rows = pieces.mapInArrow(run, schema).collect()
    shipped.destroy()
    for row in sorted(rows, key=lambda r: r["part"]):
        first = np.zeros(row["size"])
        first[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["first"])
        yield first, np.frombuffer(row["second"])


def fit_chain(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hashed features and of the moves, by adaptive gradient ascent."""
    size = pieces.agg(F.sum(F.octet_length("tags"))).first()[0]
    weights, move = np.zeros(SLOTS), np.zeros((2, 2))
    weight_norm, move_norm = np.full(SLOTS, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(ROUNDS):
        slope, move_slope = -DECAY * size * weights, -0.1 * move
        for part, move_part in of_pieces(pieces, Piece.slopes, weights, move):
            slope += part
            move_slope += move_part.reshape(2, 2)
        weight_norm += slope**2
        weights += RATE * slope / np.sqrt(weight_norm)
        move_norm += move_slope**2
        move += RATE * move_slope / np.sqrt(move_norm)
    return weights, move


def summary(marginals: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """Per document: a constant, the log odds of its two largest marginals, and their logged sum."""
    order = np.lexsort((marginals, owner))
    counts = np.bincount(owner, minlength=documents)
    last = np.cumsum(counts) - 1
    columns = [np.ones(documents)]
    for nth in range(2):
        most = np.zeros(documents)
        having = counts > nth
        most[having] = marginals[order[last[having] - nth]]
        clipped = np.clip(most, 1e-6, 1 - 1e-6)
        columns.append(np.log(clipped / (1 - clipped)) / 4)
    total = np.bincount(owner, weights=marginals, minlength=documents)
    return np.stack([*columns, np.log1p(total)], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def calibrate(inputs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights by damped Newton steps; no slope goes below zero."""
    weights = np.zeros(inputs.shape[1])
    for _ in range(30):
        p = sigmoid(inputs @ weights)
        hessian = (inputs * (p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(len(weights))
        weights += np.linalg.solve(hessian, inputs.T @ (labels - p) - 0.1 * weights)
        weights[1:] = np.maximum(weights[1:], 0)
    return weights


def fit(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    may_learn: Column, toxic: int, clean: int,
) -> Model:
    """A model of the labelled texts; without texts of both classes every score is their rate.

    Word beginnings are counted in all labelled texts, the chain and the calibration are fitted
    to `toxic` and `clean` texts at most, in the order of a hash of them. Equal texts of a class
    are one. Scores are those of documents mixed as all those to draw from, copies counted each.
    """
    known = labels.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    text = F.col(f"`{text_col}`")
    able = df.where(may_learn & text.isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (F.octet_length(text) <= LONGEST_SAMPLED).alias("short"),
    )
    found = known.join(able.select("id", "digest", "short").distinct(), "id")
    found = checkpointed(found.groupBy("digest", "label", "short").count())
    sizes = found.groupBy("label").agg(
        F.count("*").alias("texts"),
        F.count_if("short").alias("short"),
        F.sum(F.when(F.col("short"), F.col("count")).otherwise(0)).alias("documents"),
    )
    size = {r["label"]: r for r in sizes.collect()}
    drawn = {label: min(most, size[label]["short"]) for label, most in ((0, clean), (1, toxic)) if label in size}
    if not all(drawn.get(label) for label in (0, 1)):
        rate = (drawn.get(1, 0) + 0.5) / (sum(drawn.values()) + 5)
        return Model(np.zeros(SLOTS), np.zeros((2, 2)), np.array([np.log(rate / (1 - rate)), 0, 0, 0]))
    sides = found.groupBy("digest").agg(
        F.max(1 - F.col("label")).alias("clean"), F.max("label").alias("toxic")
    )
    texts = able.groupBy("digest").agg(F.min("text").alias("text")).join(sides, "digest")
    counted = counted_beginnings(texts.select("text", "toxic", "clean"))
    telling = telling_beginnings(counted, size[1]["texts"], size[0]["texts"])
    chosen = [
        found.where(F.col("short") & (F.col("label") == label)).orderBy("digest").limit(most)
        for label, most in drawn.items()
    ]
    chosen = chosen[0].unionByName(chosen[1]).select("digest", "label")
    sample = able.select("digest", "text").join(F.broadcast(chosen), "digest")
    sample = sample.groupBy("digest", "label").agg(F.min("text").alias("text"))
    pieces = tagged_pieces(sample, telling)
    weights, move = fit_chain(pieces)
    inputs, truth = zip(*of_pieces(pieces, Piece.inputs, weights, move))
    truth = np.concatenate(truth)
    calibration = calibrate(np.concatenate(inputs).reshape(len(truth), -1), truth)
    calibration[0] += np.log(size[1]["documents"] / size[0]["documents"])
    calibration[0] -= np.log(truth.sum() / (1 - truth).sum())
    return Model(weights, move, calibration)


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    may_learn: Column, keep: list[str] | None = None,
    toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE,
) -> DataFrame:
    """`row` (the kept columns), `score` from 0 to 1 and `spans` (start, stop, score).

    Learns from rows that `may_learn` and that `labels` calls 0 or 1 (of several labels the
    largest; of several texts with one id each teaches); rows without an id teach nothing. The
    beginnings of words are counted in all of these; the chain is fitted to a bounded sample,
    `toxic_sample` and `clean_sample` distinct texts of at most LONGEST_SAMPLED bytes.
    Only the text enters a score. Missing and empty texts get the score of a text without a
    suspicious word; texts of any length are scored whole; repeated rows each get the same
    score. Other columns pass in `row`, and an empty table gives an empty result. Without labels
    of both classes all texts get one low score. Spans are runs of tokens that are rather toxic
    than not, as code points of the text.
    """
    model = fit(df, labels, id_col, text_col, label_col, may_learn, toxic_sample, clean_sample)
    used = np.flatnonzero(model.weights)
    shipped = df.sparkSession.sparkContext.broadcast(
        (used.astype(np.int32), model.weights[used], model.move, model.calibration)
    )
    rows = carried(df, keep, text_col)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, move, calibration = shipped.value
        weights = np.zeros(SLOTS)
        weights[used] = values
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = tokens(part.column("text"))
                count = part.num_rows
                words = np.bincount(found.owner, minlength=count)
                marginals, _, _ = Chain(words).marginals(emission(weights, found), move)
                score = sigmoid(summary(marginals, found.owner, count) @ calibration)
                spans = toxic_spans(found, marginals, part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(score), spans], ["row", "score", "spans"]
                )

    return rows.mapInArrow(
        run, f"row {kind}, score double, spans array<struct<start:long,stop:long,score:double>>"
    )


def toxic_spans(found: Tokens, marginals: np.ndarray, part: pa.RecordBatch) -> pa.Array:
    spans: list[list] = [[] for _ in range(part.num_rows)]
    at = np.flatnonzero(marginals >= 0.5)
    if len(at):
        characters = np.concatenate([[0], np.cumsum((found.raw & 0xC0) != 0x80)])
        base = characters[text_buffer(part.column("text"))[1]]
        joined = (np.diff(at, prepend=-2) == 1) & (
            np.diff(found.owner[at], prepend=-1) == 0
        )
        heads = np.flatnonzero(~joined)
        lasts = np.append(heads[1:], len(at)) - 1
        peak = np.maximum.reduceat(marginals[at], heads)
        for h, l, p in zip(at[heads], at[lasts], peak.tolist()):
            d = found.owner[h]
            spans[d].append({
                "start": int(characters[found.starts[h]] - base[d]),
                "stop": int(characters[found.stops[l]] - base[d]), "score": p,
            })
    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])
    return pa.array(spans, pa.list_(kind))
