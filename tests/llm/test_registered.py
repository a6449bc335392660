"""Registered queries without SQL against brute force, over the whole smallest tables."""

import hashlib
import struct
import zlib
from collections import Counter

import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from quillgrid.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def answer(spark, name):
    return {r["doc_id"]: r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def jump(key, buckets):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_op1(spark, texts):
    got = answer(spark, "op1_shards")
    assert set(got) == set(texts)
    for i, r in got.items():
        data = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    for shard in range(24):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_op4(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = answer(spark, "op4_bpe")
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert r["decoded_sha256"] == sha(decoded.encode())


def test_op8(spark, texts):
    window = 400
    data = {i: t.encode() for i, t in texts.items()}
    often = Counter(hash(d[j : j + window]) for d in data.values() for j in range(len(d) - window + 1))
    got = answer(spark, "op8_suffix_dedup")
    assert set(got) == set(texts) and sum(r["n_removed"] > 0 for r in got.values()) > 5
    for i, d in data.items():
        gone = bytearray(len(d))
        for j in range(len(d) - window + 1):
            if often[hash(d[j : j + window])] > 1:
                gone[j : j + window] = b"\1" * window
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [0, *gone]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), sum(gone), spans, sha(kept))


def test_op10(spark, texts):
    def fingerprint(text):
        words = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        grams = [b" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        counts = [0] * 64
        for gram in grams:
            h = xxhash.xxh64_intdigest(gram, 42)
            for bit in range(64):
                counts[bit] += h >> bit & 1
        return sum((2 * c > len(grams)) << bit for bit, c in enumerate(counts))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = answer(spark, "op10_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{prints[i]:016x}", find(i)) for i in ids
    }
