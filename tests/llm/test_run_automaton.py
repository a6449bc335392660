import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import queries
from quillgrid.llm.run_automaton import (
    LinkCutAccess,
    SuffixAutomaton,
    collapse_runs,
    runs_of,
    squares,
    stretches,
)


def brute_runs(words, least_length=24, least_exponent=3):
    """Every period is tried at every word."""
    least = {}
    for period in range(1, len(words) // least_exponent + 1):
        at = period
        while at < len(words):
            stop = at
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            length = stop - at + period
            if stop > at and length >= max(least_length, least_exponent * period):
                least.setdefault((at - period, length), period)
            at = max(stop, at) + 1
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {j for s, n, p in runs for j in range(s + p, s + n)}
    return [w for j, w in enumerate(words) if j not in gone]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 3), max_size=90),
    st.integers(0, 60), st.integers(1, 12), st.integers(0, 50),
    st.sampled_from([(24, 3), (6, 3), (4, 2), (2, 2), (10, 4), (7, 3)]),
)
def test_runs_equal_brute_force(words, at, period, length, least):
    words = words[:at] + [words[(at + i % period) % len(words)] for i in range(length) if words] + words[at:]
    expected = brute_runs(words, *least)
    assert runs_of(words, *least) == expected
    pair = np.array([*words, *words], np.int64)
    parts = stretches(pair, np.array([len(words), 2 * len(words)]), *least)
    for k in (0, len(words)):
        inside = [(f - k + s, n, p) for f, x in parts if k <= f < k + max(1, len(words)) for s, n, p in runs_of(pair[f:x].tolist(), *least)]
        assert sorted(inside, key=lambda r: (r[0], r[2])) == expected


def test_pieces_hold_the_last_earlier_occurrence():
    """Against a search for every suffix of every prefix."""
    rng = random.Random(3)
    for _ in range(30):
        words = [rng.randrange(2) for _ in range(40)]
        automaton = SuffixAutomaton(words)
        tree = LinkCutAccess(automaton.link)
        for end, node in enumerate(automaton.prefix):
            pieces = list(tree.access(node, end))
            for size in range(1, end + 2):
                longer = [colour for node, colour in pieces if automaton.length[node] >= size]
                suffix = words[end - size + 1 : end + 1]
                before = [e for e in range(size - 1, end) if words[e - size + 1 : e + 1] == suffix]
                assert longer[-1] == max(before, default=-1)


def test_squares_have_primitive_halves():
    rng = random.Random(4)
    for _ in range(50):
        words = [rng.randrange(2) for _ in range(60)]
        for end, period in squares(words):
            half = words[end - period + 1 : end + 1]
            assert words[end - 2 * period + 1 : end - period + 1] == half
            assert all(half != half[k:] + half[:k] for k in range(1, period))


def test_awkward_rows(spark, awkward):
    period = "a b\tc\x0bd "
    nested = ("x " * 30 + "y ") * 4
    long = " ".join(f"w{i % 4000}" for i in range(30_000))
    texts = [None, "", " \t\n", period * 9, "lone", period * 9, nested, long, "é\x1f\xa0 " * 40, "a " * 23]
    frame = awkward(texts)
    frame = frame.union(frame.limit(4))
    rows = collapse_runs(frame, "text").collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        words = (r["row"]["text"] or "").encode().split()
        runs = [tuple(x) for x in r["runs"]]
        if r["row"]["text"] != long:
            assert runs == brute_runs(words)
        left = collapsed(words, runs)
        assert (r["n_words"], r["n_dropped"]) == (len(words), len(words) - len(left))
        assert r["collapsed"].encode() == b" ".join(left)
    found = {r["row"]["text"]: [tuple(x) for x in r["runs"]] for r in rows}
    assert found[long] == [(0, 30_000, 4000)]
    assert found["a " * 23] == []
    assert (0, 124, 31) in found[nested] and len(found[nested]) == 5
    assert collapse_runs(frame.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        collapse_runs(frame, "text", least_exponent=1)


def test_the_query_against_a_loop(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for doc in docs:
        words = (doc["text"] or "").encode().split()
        h = zlib.crc32(str(doc["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        row = got[doc["doc_id"]]
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
        assert row["collapsed_sha256"] == sha(b" ".join(collapsed(words, runs)))
        best = None
        for s, n, p in runs:
            if best is None or n * best[2] > best[1] * p:
                best = (s, n, p)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])


def test_empty_texts_of_the_query(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, " "] * 20)], "doc_id long, text string")
    assert {r["text"] for r in queries.with_periods(frame, "doc_id", "text").collect()} == {"", " "}
    frame = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert queries.with_periods(frame, "doc_id", "text").first()["text"] == "a b"
