import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrid.llm import queries
from quillgrid.llm import token_alignment as ta

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def brute():
    """Whole texts through the libraries, links one by one."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    of = ta.byte_of_character()

    def groups(text):
        want = (" " + (text or "")).encode()
        if not text:
            return None
        first = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        second = [
            (i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
            for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))
        ]
        if b"".join(t for _, t in first) != want or b"".join(t for _, t in second) != want:
            return None
        ends = [set(), set()]
        for side, tokens in enumerate((first, second)):
            at = 0
            for _, t in tokens:
                at += len(t)
                ends[side].add(at)
        cuts = sorted(ends[0] & ends[1])
        out = [([], []) for _ in cuts]
        for side, tokens in enumerate((first, second)):
            at = k = 0
            for i, t in tokens:
                at += len(t)
                out[k][side].append(i)
                k += at == cuts[k]
        return out

    def results(texts):
        found = [groups(t) for t in texts]
        links = [Counter((i, j) for x, y in g or [] for i in x for j in y) for g in found]
        count = Counter(p for link in links for p in link)
        highest = defaultdict(int)
        for (i, _), n in count.items():
            highest[i] = max(highest[i], n)
        rows = []
        for g, link in zip(found, links):
            line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or [])
            rows.append((
                sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(link.values()),
                sum(n for p, n in link.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in link.items()),
                "" if g is None else hashlib.sha256(line.encode()).hexdigest(),
            ))
        return rows

    return results


CHARACTERS = st.sampled_from(list("ab'sé \n\t.,1x  ") + ["　", "▁", "日", "🙂", "\x1f", "\0"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(CHARACTERS, max_size=6), max_size=7), st.randoms(use_true_random=False))
def test_fragments_compose_in_any_order(pieces, rng):
    pieces[:1] = [" " + "".join(pieces[:1])]
    # The closed texts of a fragment's pieces, joined, are those of the whole.
    parts = [(f, [c] if c else []) for f, c in map(ta.fragment_of, pieces)]
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        (f, c), (g, d) = parts[i], parts[i + 1]
        joined, between = ta.composed(f, g)
        parts[i : i + 2] = [(joined, [*c, *([between] if between else []), *d])]
    fragment, closed = parts[0]
    whole, inside = ta.fragment_of("".join(pieces))
    assert (fragment, "".join(closed)) == (whole, inside)
    assert ta.composed(ta.EMPTY, whole)[0] == whole == ta.composed(whole, ta.EMPTY)[0]


TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b   c ", "<|endoftext|> x <s></s> <0x0A>", "x▁y z", "▁", "line\n  two\r\n\r\n three\t\tfour",
    "it's we'll I'M don't", "naïve café — “quotes” … €5", "日本語のテキスト と 空白　全角", "🙂🙃 👩‍👩‍👧 é  x y", "\0 nul \x1f unit \x85 next",
    "aaaa" * 300, "word " * 500, "1234567890" * 30, "x" + " " * 3000 + "y", "\n" * 500 + " z", "ends in blank \n ",
    "the same text twice", "the same text twice",
]


def got(frame):
    return sorted((r["row"]["chunk"], *[r[c] for c in COLUMNS]) for r in frame.collect())


def test_awkward_rows_in_chunks(spark, awkward, brute):
    frame = awkward(TEXTS)
    found = got(ta.align_texts(frame.repartition(3), "text", A_PATH, B_PATH, chunk_bytes=300))
    assert [r[1:] for r in found] == brute(TEXTS)
    assert ta.align_texts(frame.limit(0), "text", A_PATH, B_PATH).count() == 0


def test_long_texts_in_pieces(spark, awkward, brute):
    rng = random.Random(5)
    words = "the of and a'b  naïve 日本 x1 \n\n, . don't 🙂".split(" ")
    texts = [*TEXTS, *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(20)]]
    frame = awkward(texts)
    for options in ({"long_bytes": 5, "piece_chars": 7, "fan": 3}, {"long_bytes": 300, "piece_chars": 41, "fan": 2}):
        found = got(ta.align_texts(frame.repartition(4), "text", A_PATH, B_PATH, **options))
        assert [r[1:] for r in found] == brute(texts)


def test_the_query_against_whole_texts(spark, brute):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.QUERIES["op13_alignment"](spark, folder).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == brute([d["text"] for d in docs])


def test_large_groups_and_blocks_change_nothing(brute, monkeypatch):
    with open(A_PATH) as a, open(B_PATH, "rb") as b:
        tokenizers = ta.TwoTokenizers(a.read(), b.read())
    texts = [t or "" for t in TEXTS]
    want = brute(texts)
    for block, large in ((20_000, 4_096), (2, 0), (3, 1)):
        monkeypatch.setattr(ta, "BLOCK", block)
        monkeypatch.setattr(ta, "LARGE_GROUP", large)
        found = ta.aligned(tokenizers, texts)
        assert [r[:4] for r in want] == [tuple(c) for c in found.counts.T.tolist()]
        ends = np.append(0, found.ends)
        assert [r[3] for r in want] == [found.weights[i:j].sum() for i, j in zip(ends, ends[1:])]
        sha = [hashlib.sha256(x.encode()).hexdigest() if g else "" for x, g in zip(found.lines, found.agrees)]
        assert [r[6] for r in want] == sha


def test_tokenizers_without_certain_cuts_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json")) as a, open(B_PATH, "rb") as b:
        with pytest.raises(ValueError, match="first tokenizer"):
            ta.TwoTokenizers(a.read(), b.read())
