import random
import re

import pytest

from quillgrid.llm import suffix_decontam


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(texts, items, window):
    found = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for size in {len(f) for f in found}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in found:
                    hit.update(range(p, p + size))
                    ids |= found[tuple(w[p : p + size])]
        out.append((len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_decontam, "SHARD_BYTES", 4000)
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "naïve", "X-y"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(99, items[0][1]), (98, ""), (97, None), (None, "lonely words"), (96, "!!")]
    texts = []
    for i in range(150):
        text = rng.choices(vocabulary + [f"z{j}" for j in range(200)], k=rng.randint(0, 120))
        if i % 3 == 0:
            text.insert(rng.randint(0, len(text)), rng.choice(items[:25])[1].upper())
        texts.append(" ".join(text))
    texts += [None, "", "lonely words"]
    docs = table(spark, list(enumerate(texts)), "doc_id long, text string")
    bench = table(spark, items, "item_id long, text string")
    got = suffix_decontam.contamination(docs, bench, "text", "item_id", "text").collect()
    got = [tuple(r[c] for c in ("n_words", "n_hit", "items", "contaminated")) for r in sorted(got, key=lambda r: r["row"]["doc_id"])]
    want = [(n, h, [str(x) for x in ids], c) for n, h, ids, c in brute(texts, items, 13)]
    assert got == want


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = "before " + " ".join(f"W{i}" for i in range(5, 30)) + " after"
    docs = table(spark, [(1, text)], "doc_id long, text string")
    bench = table(spark, [("q", item)], "item_id string, text string")
    row = suffix_decontam.contamination(docs, bench, "text", "item_id", "text").first()
    assert [tuple(m) for m in row["matches"]] == [("q", 5, 1, 25)]


def test_awkward_rows(spark, awkward):
    passage = " ".join(f"p{i}" for i in range(13))
    frame = awkward([None, "", passage, "x " * 100_000 + passage, passage])
    bench = table(spark, [(1, passage)], "item_id long, text string")
    got = suffix_decontam.contamination(frame, bench, "text", "item_id", "text").collect()
    state = sorted((r["row"]["chunk"], r["n_hit"], r["contaminated"]) for r in got)
    assert state == [(0, 0, False), (1, 0, False), (2, 13, True), (3, 13, False), (4, 13, True)]
    assert got[0]["row"]["row"] == "x"
    run = suffix_decontam.contamination
    assert run(frame.limit(0), bench, "text", "item_id", "text").count() == 0
    assert run(frame, bench.limit(0), "text", "item_id", "text").where("n_hit > 0").count() == 0
