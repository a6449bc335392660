import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgrid.llm import forced_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdefXYZ éèßÅ Σσς'sStT0١²½  ​́\u0085\x1c\t\n\r😀👩‍👧文字ⅣǅİIıŉﬁ<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return forced_bpe.ForcedBpe(forced_bpe.read_tokenizer(PATH))


def sample():
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return texts + [
        "", " ", "<|endoftext|>a<|startoftext|>", "<|endoftext|", "İstanbul ΑΣ", "it's I'LL", "a" * 5000,
        "ab" * 3000, "\x00\x01", "the " * 20_000,
    ]


def test_equals_the_library(bpe, library):
    texts = sample()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        packed, tokens = bpe.encode(text)
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == want.ids, text
        assert tokens == bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_where_no_token_has_the_pair(bpe):
    symbols = [bpe.symbols[b] for b in "qxzthe".encode()]
    pieces = bpe.cut(symbols)
    assert "".join("".join(p) for p in pieces) == "qxzthe" and len(pieces) > 1
    # The last symbol of an ended token is another one, as it holds the end of the word.
    bare = [t[: -len(bpe.suffix) - 1] if t.endswith(bpe.suffix) else t for t in bpe.vocabulary]
    for left, right in zip(pieces, pieces[1:]):
        assert not any(left[-1] + right[0] in token for token in bare)


def test_both_ways_of_merging_agree(bpe):
    rng = random.Random(3)
    for _ in range(500):
        symbols = [rng.choice("abcdeinrst") for _ in range(rng.randint(1, 30))]
        assert bpe.merge(symbols) == bpe.merge_many(symbols)


def test_table(spark, awkward, library):
    texts = [None, "", "Hello World", "x" * 50_000, "Hello World"]
    frame = awkward(texts)
    got = forced_bpe.encode_texts(frame, "text", PATH, digests=True).collect()
    assert len(got) == 5
    for r in got:
        want = library.encode(r["row"]["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        decoded = library.decode(want, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert r["row"]["row"] == "x"
    assert forced_bpe.encode_texts(frame.limit(0), "text", PATH).count() == 0
    ids = forced_bpe.encode_texts(frame, "text", PATH, keep=["doc_id"])
    back = forced_bpe.decode_ids(ids, "ids", PATH).select("row.ids", "decoded").collect()
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in back)
