"""Packing: ids as the tokenizers library gives them, mixtures, shared queues, awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillwork.llm import common, packing

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    coder = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    return lambda text: coder.encode(text, add_special_tokens=False).ids


def coded(text):
    coder = packing.text_coder(*packing.public_coder())
    return np.frombuffer(coder.encode(text), coder.dtype).tolist()


@pytest.mark.parametrize("text", [SPECIAL, f"{SPECIAL} begins", f"a {SPECIAL} b", f"a{SPECIAL}b", f"ends {SPECIAL}", f"two  {SPECIAL}\n{SPECIAL}", "<|endoftext |>", "", " ", "a  b", "caf\u00e9 \u65e5\u672c \U0001f642", "it's we'll 'tis"])
def test_ids_with_the_added_token(library, text):
    assert coded(text) == library(text)


def test_ids_of_random_texts(library):
    pick = random.Random(7)
    parts = ["the", "cat", "'s", " ", "  ", "\n", "\t", "42", "\u00a0", "\u3000", "\u00e9", "\u65e5", "\U0001f642", "!?", "_x", SPECIAL, "\u200b", "\u0301"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert coded(text) == library(text), repr(text)


def test_ids_of_every_code_point(library):
    for at in range(0, 0x110000, 4096):
        part = "".join(f"a{c}a 1{c}1 {c}\n{c}  {c}." for c in map(chr, range(at, at + 4096)) if not "\ud800" <= c <= "\udfff")
        assert coded(part) == library(part), hex(at)


def test_ids_of_very_long_texts(library):
    for text in (" " * 1_500_000, "x" * 300_000, "a b" * 150_000, "\n" * 199_999):
        assert coded(text) == library(text)


def test_vocabulary_size():
    path = common.tokenizer_path("byte_bpe_50k.json")
    assert packing.vocabulary_size(path) == Tokenizer.from_file(path).get_vocab_size() and packing.id_type(1 << 17)[1] == "<u4"


def test_cache_is_bounded_by_bytes():
    cache = common.ByteBound()
    for i in range(9):
        cache.fit()
        cache.put(f"{i}" * (cache.LIMIT // 8), b"x")
        assert cache.missing({"0" * (cache.LIMIT // 8), "new"}) == ["new"]  # what is asked for stays
    assert cache.size <= cache.LIMIT and len(cache.held) + len(cache.old) < 12
    assert cache.missing({"2" * (cache.LIMIT // 8)})


def corpus():
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("bdfglmnprst") + pick.choice("aeiou") for _ in range(2))
    rows = [(i, " ".join(word() for _ in range(pick.randint(0, 400))), pick.choice(["hot", "hot", "hot", "b", "c"]), 1) for i in range(900)]
    rows += [(1000 + i, " ".join(word() for _ in range(30)), f"small{i}", 1) for i in range(40)]
    rows += [(2000, None, None, 1), (2001, "", "b", 1), (2002, "x " * 30_000, "+", 1), (None, "no id", "hot", 1), (None, "no id", "hot", 1), (5, rows[5][1], rows[5][2], 1), (2003, f"a {SPECIAL} b", "=", 1)]
    return rows


def pieces(df, **kw):
    got = packing.pack(df, **kw).collect()
    at = sorted((r.sequence_id * packing.SEQUENCE + r.offset, r.length) for r in got)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    assert all(r.offset + r.length <= packing.SEQUENCE and r.length > 0 and r.ids_crc32 == zlib.crc32(r.ids) and 4 * r.length == len(r.ids) for r in got)
    return got


def test_awkward_rows(spark, library):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(4)
    got = pieces(df)
    whole = defaultdict(list)
    for r in got:
        whole[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
    for i, t, *_ in rows:
        ids = [*library(t or ""), 1]
        if Counter(x[0] for x in rows)[i] == 1:
            parts = sorted(whole[i])
            assert np.frombuffer(b"".join(p[2] for p in parts), "<u4").tolist() == ids
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and {p[3] for p in parts} == {len(ids)}
    assert sum(r.length for r in got) == sum(len(library(t or "")) + 1 for _, t, *_ in rows)
    assert len(whole[None]) >= 2 and sum(n for _, n, *_ in whole[5]) == 2 * (len(library(rows[5][1])) + 1)


def windows(got, sources, queues, window):
    """Tokens by queue in each window but the last."""
    mix = defaultdict(Counter)
    for r in got:
        at, end = r.sequence_id * packing.SEQUENCE + r.offset, 0
        while end < r.length:
            k = (at + end) // window
            step = min(r.length - end, (k + 1) * window - at - end)
            mix[k][queues.get(sources[r.doc_id], "shared")] += step
            end += step
    return [mix[k] for k in sorted(mix)]


def test_windows_hold_the_mixture_and_small_sources_share_a_queue(spark, monkeypatch):
    window = 1 << 15
    monkeypatch.setattr(packing, "BLOCK_ROWS", 50)
    monkeypatch.setattr(packing, "SUM_BLOCKS", 4)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    got = pieces(df, window=window)
    sources = {i: s or "" for i, _, s, _ in rows}
    total = Counter()
    for r in got:
        total[sources[r.doc_id]] += r.length
    share = sum(total.values()) * packing.SEQUENCE // window
    own = {s: s for s, n in total.items() if n >= share}
    assert {"hot", "b", "c", "+"} == set(own) and len(total) > 40
    mix = windows(got, sources, own, window)
    assert len(mix) > 4
    every = sum(mix, Counter())
    for q in every:
        for k in range(1, len(mix)):
            assert abs(sum(m[q] for m in mix[:k]) - k * window * every[q] / sum(every.values())) <= len(every)
    # documents of small sources stay in few pieces
    parts = Counter(r.doc_id for r in got if sources[r.doc_id].startswith("small"))
    assert max(parts.values()) <= 3 and sum(parts.values()) < 40 + 2 * len(mix) + len(mix) * window // packing.SEQUENCE


def test_targets_are_honoured_until_a_queue_is_empty(spark):
    window = 1 << 11
    rows = [r for r in corpus() if r[0] is not None and r[0] != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    got = pieces(df, targets={"b": 3.0, "small1": 1.0, "hot": 0.0}, window=window)
    sources = {i: s or "" for i, _, s, _ in rows}
    mix = windows(got, sources, {"b": "b", "small1": "small1"}, window)
    total = sum(r.length for r in got if sources[r.doc_id] == "small1")
    # 3 to 1 as long as the small source lasts, then the other one alone, then the rest
    alone = next(k for k, m in enumerate(mix) if not m["small1"])
    assert all(abs(m["b"] - 3 * m["small1"]) <= 8 for m in mix[: 4 * total // window])
    assert mix[alone + 1] == {"b": window} and mix[-1]["b"] == 0
    with pytest.raises(ValueError):
        packing.pack(df, targets={"unheard of": 1.0})
