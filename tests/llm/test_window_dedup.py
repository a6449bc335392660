import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgrid.llm import fm_dedup, rlbwt_dedup
from quillgrid.llm.window_exchange import fragments

SETTINGS = [{}, {"crowd": 3, "chunk_bytes": 3000}, {"crowd": 1, "chunk_bytes": 500}]


def kept_words(rows, window):
    """(n_words, n_removed, kept) per row; rows in the order of id and reading."""
    seen, out = set(), []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def kept_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + window] for d in data for p in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - window + 1):
            if count[d[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, kept))
    return out


def corpus(seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "naïve", "a.b", "<|x|>"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 50))) for _ in range(6)]
    texts = []
    for i in range(120):
        kind = i % 6
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))
        if kind == 0:
            text += " " + rng.choice(passages) + rng.choice([" ", "\n", "  "]) + text[:50]
        elif kind == 1 and texts:
            copy = rng.choice(texts).split(" ")
            copy[rng.randrange(len(copy))] = "edit"
            text = " ".join(copy)
        elif kind == 2:
            text += " " + "und " * rng.randint(0, 60) + rng.choice(["", "a b " * 30])
        elif kind == 3 and texts:
            text = rng.choice(texts)
        texts.append(text)
    return texts + ["", None, "nospace" * 100, "nospace" * 90 + "x", "\x00" * 200]


@pytest.mark.parametrize("setting", SETTINGS)
@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed, setting):
    rows = list(enumerate(corpus(seed)))
    frame = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(4)
    if setting:
        setting = setting | {"shard_words": 500}
    got = fm_dedup.remove_repeated_words(frame, "doc_id", "text", 20, ["doc_id"], **setting)
    got = {r["row"]["doc_id"]: r for r in got.collect()}
    for (i, _), want in zip(rows, kept_words(rows, 20)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == want, i
        assert sum(s["n_words"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("setting", SETTINGS)
@pytest.mark.parametrize("window", [40, 64, 150])
def test_bytes_equal_brute_force(spark, window, setting):
    texts = corpus(3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    if setting:
        setting = setting | {"shard_bytes": 3000}
    got = rlbwt_dedup.remove_repeated_bytes(frame, "doc_id", "text", window, ["doc_id"], **setting)
    got = {r["row"]["doc_id"]: r for r in got.collect()}
    for i, want in enumerate(kept_bytes(texts, window)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == want, i


def test_awkward_rows(spark, awkward):
    long = " ".join(str(i) for i in range(60_000))
    text = " ".join(f"t{i}" for i in range(30))
    frame = awkward([None, "", text, text, long, "9 " + long]).coalesce(1)
    frame = frame.union(frame.where("chunk = 3").coalesce(1))
    got = fm_dedup.remove_repeated_words(frame, "doc_id", "text", 20).collect()
    state = sorted((r["row"]["chunk"], r["n_words"], r["n_removed"]) for r in got)
    # The row without an id comes first and keeps all; one of the repeated rows is no better.
    assert state == [(0, 0, 0), (1, 0, 0), (2, 30, 0), (3, 30, 30), (3, 30, 30), (4, 60_000, 0), (5, 60_001, 60_000)]
    assert got[0]["row"]["row"] == "x" and "text" in got[0]["row"].asDict()
    got = rlbwt_dedup.remove_repeated_bytes(frame, "doc_id", "text", 60).collect()
    size = len(text)
    lost = {r["row"]["chunk"]: r["n_bytes"] - r["n_removed"] for r in got}
    assert lost == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2} and size > 60
    for run in (fm_dedup.remove_repeated_words, rlbwt_dedup.remove_repeated_bytes):
        assert run(frame.limit(0), "doc_id", "text").count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 300, 5000)
    matrix = fm_dedup.WaveletMatrix(symbols, 9)
    asked, places = rng.integers(0, 300, 400), rng.integers(0, 5001, 400)
    want = [int((symbols[:p] == s).sum()) for s, p in zip(asked, places)]
    assert matrix.rank(asked, places).tolist() == want


def test_backward_search_counts_every_window():
    rng = np.random.default_rng(2)
    parts = rng.integers(1, 4, 3000)
    ends = np.sort(rng.choice(np.arange(1, 3000), 40, replace=False))
    ends = np.append(ends, 3000)
    index = fm_dedup.FmIndex(parts, ends, 5)
    place, low, high = index.window_intervals(np.diff(ends, prepend=0))
    text = index.symbols
    count = Counter(
        tuple(text[p : p + 5]) for p in range(len(text) - 4) if 0 not in text[p : p + 5]
    )
    assert len(place) == sum(count.values())
    assert all(high[i] - low[i] == count[tuple(text[p : p + 5])] for i, p in enumerate(place))


def test_suffixes_runs_and_samples():
    rng = random.Random(5)
    base = "".join(rng.choices("ab \n", k=300)).encode()
    bodies = [base, base[20:200], b"", b"abab", base[:150] + b"\x00\xff " + base[150:]]
    index = rlbwt_dedup.RunIndex(bodies)
    ends = {int(s): int(index.end[s]) for s in range(len(index.raw))}

    def key(p):
        return [*(b + 1 for b in index.raw[p : ends[p]].tolist()), 0], p

    assert index.places.tolist() == sorted(range(len(index.raw)), key=key)
    assert len(index.heads) < len(index.raw)
    for a, b, n in zip(index.before, index.after, index.agree):
        x, y = index.raw[a : ends[a]].tolist(), index.raw[b : ends[b]].tolist()
        common = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common == n


def test_a_marker_that_repeats_inside_one_fragment_is_counted():
    batch = pa.RecordBatch.from_pydict({"text": ["und " * 50], "order_id": [1]})
    from quillgrid.llm.window_exchange import Setting

    setting = Setting(20, 8, 10, 1, 1, fm_dedup.word_units, None, True)
    _, _, length, times = fragments(fm_dedup.word_units(batch), setting)
    assert length.tolist() == [31] and times.tolist() == [43]
