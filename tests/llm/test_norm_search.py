import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import norm_search

SCHEMA = "vec_id long, embedding array<float>, score long, v string, length double"


def brute(rows, every, k):
    table = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        table[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = {}
    for q, a in table.items():
        if q % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in table.items() if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def run(spark, rows, every=5, k=5):
    frame = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], SCHEMA)
    got = norm_search.top_products(
        frame, "vec_id", norm_search.quantised(F.col("embedding")), F.col("vec_id") % every == 0, k
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return found


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(norm_search, "QUERY_BLOCK", 17)
    monkeypatch.setattr(norm_search, "BUCKET", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(600):
        v = centres[i % 6] + 0.3 * rng.normal(size=24)
        v = v / np.linalg.norm(v) * math.exp(spread * rng.normal())
        rows.append((i, [float(x) for x in v]))
    assert run(spark, rows) == brute(rows, 5, 5)


def test_awkward_vectors(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(12)] + [
        (20, None), (25, [None, 1.0, 1.0]), (30, [float("nan"), 0.0, 0.0]), (35, [float("inf"), 0.0, 0.0]),
        (None, same), (40, [0.0, 0.0, 0.0]), (45, [-1.0, -1.0, -1.0]), (50, [1.0]), (11, same),
    ]
    got = run(spark, rows)
    assert got == {q: v for q, v in brute(rows, 5, 5).items() if v}
    assert got[0] == [(i, 128 * 128 + 64 * 64 + 32 * 32) for i in (1, 2, 3, 4, 5)]
    assert run(spark, []) == {}


def test_one_id_with_more_vectors_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(norm_search, "QUERY_BLOCK", 2)
    rows = [(0, [i, 1]) for i in range(8)] + [(1, [8, 0]), (2, [0, 0]), (0, []), (3, [])]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    found = norm_search.top_products(frame, "id", F.col("v"), F.col("id") == 0, k=2)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1, 56), (0, 2, 2, 0)]
