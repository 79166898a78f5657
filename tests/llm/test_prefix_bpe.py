"""Encoding by prefixes against the tokenizers library, and against merging step by step."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillwork.llm import prefix_bpe
from quillwork.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.PrefixCoder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def same(coder, library, texts):
    got = [ids(c) for c in coder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for t, g in zip(texts, got, strict=True):
        assert coder.decode(np.array(g, "<u4").tobytes()) == library.decode(g, skip_special_tokens=False) == t


def test_texts_against_the_library(coder, library):
    r = random.Random(3)
    alphabet = ["a", "aa", "b", "e", "th", " ", "  ", "\n", "\r", "é", "日", "🙂", "0", "12", "'s", "'ll", "=", "==", "՘", "\x1c", "\x00", "<|endoftext|>", "<|endof", "-", "\t", "ſ", " ", "\xa0", "ing", "​", "ا"]
    same(coder, library, ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(4000)])
    same(coder, library, ["".join(chr(r.randrange(128)) for _ in range(r.randrange(30))) for _ in range(4000)])
    same(coder, library, [x * n for x in ("a", "=", " ", "\n", "ab", "the ", "aab") for n in range(0, 150, 7)])


def test_every_code_point(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(coder, library, [" ".join(f"{c}a{c}1" for c in points[at : at + 2000]) for at in range(0, len(points), 2000)])
    same(coder, library, ["".join(points[at : at + 3000]) for at in range(0, len(points), 90_000)])


def test_long_pre_tokens_and_small_caches(coder, library, monkeypatch):
    same(coder, library, ["x" * 20_000 + " y", "word " * 60_000, "ab" * 9_000 + "\n\n  " * 300])
    monkeypatch.setattr(prefix_bpe, "PAIRS", 20)
    small = prefix_bpe.PrefixCoder(PATH)
    small.cache.limit = small.parts.limit = 2_000
    monkeypatch.setattr(prefix_bpe, "SLICE_CHARS", 50)
    same(small, library, [f"word{i} other{i % 7} {i}" for i in range(600)])


def test_one_by_one_and_in_step(coder):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeintr\u0120\u00c3") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    assert coder.code_each(words) == [coder.code(w) for w in words]


def test_pair_test_against_merging_step_by_step(coder):
    merges, tokens, r = coder.merges, coder.bytes, random.Random(4)
    base = {v[0]: k for k, v in tokens.items() if len(v) == 1}

    def merged(data):
        out = [base[b] for b in data]
        while pairs := [(merges.merged[p], i) for i, p in enumerate(zip(out, out[1:])) if p in merges.merged]:
            rank, i = min(pairs)
            a, b = out[i : i + 2]
            out[i : i + 2] = [next(z for z in (coder.vocabulary[key(a) + key(b)],))]
        return out

    key = {i: t for t, i in coder.vocabulary.items()}.__getitem__
    short = [i for i, t in tokens.items() if len(t) <= 4 and i != 50256]
    for _ in range(3000):
        a, b = r.choice(short), r.choice(short)
        assert merges.meet(a, b) == merges.meet_each(np.array([a]), np.array([b]))[0] == (merged(tokens[a] + tokens[b]) == [a, b]), (a, b)
    assert all(merges.whole)


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "né\n\n x"), (4, "a <|endoftext|> b"), (5, "long text, " * 40_000)]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, ids binary, n_tokens int")
    got = prefix_bpe.encode_by_prefixes(df)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    want = []
    for i, t in rows:
        coded = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        want.append((i, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), coded))
    assert sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=str) == sorted(want, key=str)
    assert prefix_bpe.encode_by_prefixes(df.filter("false")).count() == 0
