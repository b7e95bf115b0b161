"""BPE against the tokenizers library: every code point, marks in every order, contractions, special tokens, long words."""

import hashlib
import random
import time

import pytest
import tokenizers
from pyspark.sql import functions as F

from quadrille.llm import bpe

POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding(), t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.vocabulary_path())


def differing(library, own, texts):
    ids, offs = own.both(texts)
    said = own.decoded(ids, offs).to_pylist()
    out = []
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        if want.ids != ids[offs[k] : offs[k + 1]].tolist() or library.decode(want.ids, skip_special_tokens=False) != said[k]:
            out.append(texts[k])
    return out


def test_every_code_point(library, own):
    texts = ["\n".join(f"1{c}'sa{c}̧ x{c}" for c in POINTS[at : at + 64]) for at in range(0, len(POINTS), 64)]
    assert not differing(library, own, texts)


def test_marks_and_special_tokens(library, own):
    r = random.Random(5)
    pool = [*map(chr, [*bpe._points(bpe._PLAIN_MARKS), *bpe._LOWER]), *"̧̣́áA '1Σᅡᄀᆨ가", "<|endoftext|>", "<|startoftext|>", "<|"]
    assert not differing(library, own, ["".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(20_000)])


def test_contractions_and_odd_texts(library, own):
    r = random.Random(6)
    pool = [*"'''''stmdrevlLS 12AZ\n\té中🙂\0", *(r.choice(POINTS) for _ in range(30))]
    odd = ["", " ", "'", "'s", "'re", "x'", "''s", "'S'T", "ŉ İ", "don't I'LL 12345", "<|endoftext|>", "a<|startoftext|><|endoftext|> b", "x" * 255, "x" * 256, "x" * 257, "ab" * 1500]
    assert not differing(library, own, odd + ["".join(r.choice(pool) for _ in range(r.randint(1, 25))) for _ in range(20_000)])


def test_trees_of_all_widths_agree(own):
    r = random.Random(7)
    words = ["".join(r.choice("etaoin") for _ in range(n)).encode() for n in range(1, 300)]
    flat, counts = own.merge_many(words)
    at = 0
    for word, n in zip(words, counts.tolist(), strict=True):
        assert own.merge([*(own.inner[b] for b in word[:-1]), own.last[word[-1]]]) == flat[at : at + n].tolist()
        at += n


def test_long_texts(library, own):
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    began = time.perf_counter()
    assert not differing(library, own, [" ".join(r.choice(words) for _ in range(300_000)), "q" * 20_000])
    assert time.perf_counter() - began < 60


def test_forgetting(own, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    texts = ["alpha beta gamma delta", "beta epsilon", "<|endoftext|>alpha", "delta beta zeta"]
    assert [own.encode(t) for t in texts] == [own.encode(t) for t in texts] and own.encode(texts[2])[0] == 49407


def test_report(spark, library):
    texts = [None, "", "One two, TWO", "One two, TWO", " \t", "ß " * 3000]
    rows = [(k % 5, t, "x", "y", "z") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens string, lang string").withColumn("source", F.lit("s"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.report(docs).collect()) == sorted(want)
    full = bpe.encode(docs).collect()
    assert sorted((r.doc_id, r.n_tokens, digest(" ".join(map(str, r.ids))), digest(r.decoded)) for r in full) == sorted(want)
    assert bpe.report(docs.where("false")).collect() == [] == bpe.encode(docs.where("false")).collect()
