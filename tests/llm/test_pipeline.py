import hashlib

import numpy as np
import public_tokenizers
import pytest
from test_simhash_pivots import components, fingerprint
from test_suffix_decontam import brute
from test_window_dedup import kept_words
from tokenizers import Tokenizer

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """The input and output rows of every stage."""
    found, folder = [], tmp_path_factory.mktemp("stages")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{n}")
        after = spark.read.parquet(f"{folder}/{n}")
        found.append((name, docs, after))
        docs = after
    return found


def rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_columns(stages, docs):
    for _, _, after in stages[:-1]:
        assert after.columns == docs.columns


def test_quality(stages, spark):
    _, before, after = stages[0]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = rows(after)
    assert set(kept) < set(rows(before))
    wrong = [i for i in rows(before) if i in quality and (i in kept) != (quality[i] == 1)]
    assert len(wrong) <= 0.05 * len(quality)


def test_near_dedup(stages):
    _, before, after = stages[1]
    marks = {i: fingerprint(r["text"]) for i, r in rows(before).items()}
    assert set(rows(after)) == set(components(marks, 3).values())


def test_substrings(stages):
    _, before, after = stages[2]
    inputs = sorted((i, r["text"]) for i, r in rows(before).items())
    got = rows(after)
    for (i, text), (_, lost, kept) in zip(inputs, kept_words(inputs, 20)):
        assert got[i]["text"] == (kept if lost else text)
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_decontamination(stages, spark):
    _, before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    inputs = sorted((i, r["text"]) for i, r in rows(before).items())
    found = brute([t for _, t in inputs], items, 13)
    assert set(rows(after)) == {i for (i, _), f in zip(inputs, found) if not f[3]}


def test_tokens(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(after)
    assert set(got) == set(rows(before))
    for i, r in rows(before).items():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF_DIR)) == rows(stages[-1][2])


def test_stages_on_empty_and_awkward_tables(spark, docs, awkward):
    extra = awkward([None, "", "x", "The cat sat on the mat today.", "y " * 20_000]).selectExpr(
        "doc_id", "text", "row AS lang", "row AS source", "chunk AS n_chars", "kept", "fp", "chunk AS component"
    )
    for frame in (docs.limit(0), extra):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF_DIR).collect()
