import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgrid.llm import toxic_crf, weak_quality

SF_DIR = "/root/testdata/sf0.1"


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 1, 7, 2])
    scores, move = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    got, moves, total = toxic_crf.Chain(counts).marginals(scores, move)
    want, logs, expected = [], 0.0, np.zeros((2, 2))
    at = 0
    for n in counts:
        part = scores[at : at + n]
        at += n
        weights = {}
        for path in range(1 << n):
            states = [path >> i & 1 for i in range(n)]
            value = sum(s * e for s, e in zip(states, part))
            value += sum(move[a, b] for a, b in zip([0, *states], states))
            weights[tuple(states)] = np.exp(value)
        z = sum(weights.values())
        logs += np.log(z)
        want += [sum(w for s, w in weights.items() if s[i]) / z for i in range(n)]
        for s, w in weights.items():
            for a, b in zip([0, *s], s):
                expected[a, b] += w / z
    assert np.allclose(got, want) and np.isclose(total, logs) and np.allclose(moves, expected)


def test_long_chains_are_cut_without_a_trace():
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=2000), rng.normal(size=(2, 2))
    got, _, _ = toxic_crf.Chain(np.array([2000])).marginals(scores, move)
    a, ahead = np.array([1.0, 0.0]), []
    step = np.exp(move)
    for e in scores:
        a = (a @ step) * [1.0, np.exp(e)]
        a /= a.sum()
        ahead.append(a)
    b, want = np.ones(2), [0.0] * 2000
    for t in range(1999, -1, -1):
        both = ahead[t] * b
        want[t] = both[1] / both.sum()
        b = step @ (b * [1.0, np.exp(scores[t])])
        b /= b.sum()
    assert np.allclose(got, want)


def test_held_out_toxic_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = toxic_crf.toxicity(docs, labels, "doc_id", "text", "toxic", fold != 2, keep=["doc_id", "text"])
    got = got.withColumn("doc_id", F.col("row.doc_id")).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    hits = sum(r["toxic"] == 1 and r["score"] >= 0.3 for r in held)
    assert hits / sum(r["toxic"] == 1 for r in held) > 0.85
    assert hits / sum(r["score"] >= 0.3 for r in held) > 0.85
    marked = [r for r in held if r["toxic"] == 1 and r["spans"] and r["row"]["text"].isascii()]
    words = {r["row"]["text"][s["start"] : s["stop"]].lower() for r in marked for s in r["spans"]}
    assert words and {"idiot", "trash"} & words


def test_labels_of_the_other_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 1500")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("doc_id < 1500")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    other = labels.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    run = toxic_crf.toxicity
    first, second = (
        sorted(
            (r["row"]["doc_id"], r["score"])
            for r in run(docs, table, "doc_id", "text", "toxic", fold != 2, keep=["doc_id"]).collect()
        )
        for table in (labels, other)
    )
    assert first == second


def test_toxicity_of_awkward_rows(spark, awkward):
    frame = awkward([None, "", "you idiot", "a nice day " * 30_000, "you idiot"])
    labels = spark.createDataFrame(
        [(1, 0), (2, None), (3, 1), (4, 0), (None, 1), (3, 0)], "doc_id long, toxic int"
    )
    run = toxic_crf.toxicity
    got = run(frame, labels, "doc_id", "text", "toxic", F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["row"]["row"] == "x"
    empty = run(frame, labels.limit(0), "doc_id", "text", "toxic", F.lit(True)).collect()
    assert all(r["score"] < 0.3 for r in empty)
    assert run(frame.limit(0), labels, "doc_id", "text", "toxic", F.lit(True)).count() == 0


def test_copies_do_not_crowd_out_other_toxic_texts(spark):
    texts = ["you idiot of a copied man"] * 300 + [f"what trash number {i}" for i in range(20)]
    texts += [f"a nice day number {i}" for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") < 320).cast("int").alias("toxic"))
    got = toxic_crf.toxicity(
        frame, labels, "doc_id", "text", "toxic", F.lit(True), toxic_sample=30, clean_sample=60
    ).collect()
    scores = {r["row"]["doc_id"]: r["score"] for r in got}
    assert min(scores[i] for i in range(300, 320)) > max(scores[i] for i in range(320, 420))


def test_words_are_counted_beyond_the_sample(spark):
    texts = [f"you idiot {i}" for i in range(360)] + [f"pure scum {i}" for i in range(40)]
    texts += [f"you pure day {i}" for i in range(800)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") < 400).cast("int").alias("toxic"))
    got = toxic_crf.toxicity(
        frame, labels, "doc_id", "text", "toxic", F.lit(True), toxic_sample=60, clean_sample=120
    ).collect()
    marked = {r["row"]["doc_id"]: [r["row"]["text"][s["start"] : s["stop"]] for s in r["spans"]] for r in got}
    assert all(any("scum" in m for m in marked[i]) for i in range(360, 400))
    assert not any(marked[i] for i in range(400, 1200))


def test_estimated_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    truth = np.array([[0.7, 0.3, 0.0], [0.5, 0.5, 0.0], [0.1, 0.3, 0.6]]), np.array(
        [[0.02, 0.98, 0.0], [0.05, 0.95, 0.0], [0.02, 0.08, 0.9]]
    )
    votes = np.stack(
        [
            np.where(good, rng.choice(3, 20_000, p=truth[1][i]), rng.choice(3, 20_000, p=truth[0][i]))
            for i in range(3)
        ],
        1,
    )
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    rates, share, posterior = weak_quality.estimate(patterns, counts)
    assert abs(share - 0.8) < 0.03
    assert np.abs(rates[0] - truth[0]).max() < 0.06 and np.abs(rates[1] - truth[1]).max() < 0.06
    assert ((posterior[inverse.ravel()] > 0.5) == good).mean() > 0.93


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = weak_quality.quality(docs, "text", keep=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    rows = got.join(labels, "doc_id").collect()
    clean = [r["accepted"] for r in rows if r["quality"] == 1]
    junk = [r["accepted"] for r in rows if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.99
    assert sum(junk) / len(junk) < 0.05


def test_measures_by_hand():
    texts = ["The cat sat.", "Und " * 20, "THE!! CAT!! SAT!!", "a$$$ b### c%%% d&&&", "x | y | z | q", "", None]
    votes, _, _ = weak_quality.measures(pa.array(texts))
    names = [name for name, _, _ in weak_quality.LABELLERS]
    bad = [{n for n, v in zip(names, row) if v == weak_quality.BAD} for row in votes]
    assert not bad[0] and {"repeated_neighbours", "repeated_shingles"} <= bad[1]
    assert {"upper_share", "decorated_words"} <= bad[2] and "symbols_per_word" in bad[3]
    assert "lone_symbols" in bad[4] and not bad[5] and not bad[6]
    assert votes[0][names.index("plain_words")] == weak_quality.GOOD


def test_quality_of_awkward_rows(spark, awkward):
    rng = random.Random(1)
    prose = " ".join(rng.choices(["the", "cat", "sat", "on", "mats"], k=60_000))
    frame = awkward([None, "", "The cat sat on a mat.", prose, "The cat sat on a mat."])
    got = {r["row"]["chunk"]: r for r in weak_quality.quality(frame, "text").collect()}
    assert not got[0]["accepted"] and got[0]["score"] == got[1]["score"] == 0.0
    assert got[2]["score"] == got[4]["score"] and got[0]["row"]["row"] == "x"
    assert weak_quality.quality(frame.limit(0), "text").count() == 0
