import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillgrid.llm import simhash_pivots as S


def fingerprint(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, bits):
    """Least id reachable, by comparing all."""
    ids = sorted(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(marks[a] ^ marks[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints():
    texts = ["", None, "  ", "a", "A b", "a b c\x1cd", "é É X", "w " * 700] + [
        " ".join(random.Random(i).choices("red green Blue\tx y".split(" "), k=i)) for i in range(60)
    ]
    assert S.simhash(pa.array(texts), 3).tolist() == [fingerprint(t) for t in texts]


def test_every_close_pair_shares_a_key():
    rng = random.Random(1)
    for extra in (1, 2, 3):
        masks = S.block_masks(3 + extra, extra)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any((a & m) == (b & m) for m in (m % (1 << 64) for m in masks))


@pytest.mark.parametrize(("bucket", "group"), [(20_000, 64), (12, 3), (2, 0)])
def test_components_equal_brute_force(spark, monkeypatch, bucket, group):
    monkeypatch.setattr(S, "MOST_IN_BUCKET", bucket)
    monkeypatch.setattr(S, "SMALL_GROUP", group)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(12):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(rng.choice([1, 2, 5, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy)
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    want = components({i: fingerprint(t) for i, t in texts.items()}, 3)
    got = S.near_duplicates(frame, "doc_id", "text").collect()
    assert {r["doc_id"]: r["component"] for r in got} == want
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == {i: fingerprint(t) for i, t in texts.items()}
    kept = S.representatives(frame, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_awkward_rows(spark, awkward):
    frame = awkward([None, "", "Some text here now", "some TEXT here now", "word " * 30_000, "x"])
    got = S.near_duplicates(frame.union(frame.limit(1)), "doc_id", "text").collect()
    by_id = {r["doc_id"]: r["component"] for r in got}
    assert len(got) == 7
    assert (by_id[1], by_id[2], by_id[4], by_id[None]) == (1, 1, 4, 4)
    kept = S.representatives(frame.union(frame.limit(1)), "doc_id", "text")
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert S.near_duplicates(frame.limit(0), "doc_id", "text").count() == 0
    assert S.representatives(frame.limit(0), "doc_id", "text").count() == 0


def test_a_discarded_pair_is_never_close():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    near = marks ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    table = S.distance_table(np.concatenate([marks, near]), S.pivots())
    assert np.abs(table[:500] - table[500:]).max() <= 1


def test_one_id_with_texts_of_two_groups(spark):
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue white"
    rows = [(1, a, "x"), (2, a, "y"), (1, b, "z"), (3, b, "w"), (1, a, "x"), (None, c, "n"), (None, b, "m")]
    frame = spark.createDataFrame(rows, "id long, text string, often string")
    kept = S.representatives(frame, "id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == [(1, a, "x"), (1, b, "z"), (None, c, "n")]
