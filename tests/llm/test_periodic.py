"""Periodic runs against a search over all periods, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import periodic


def brute(words):
    """Runs by comparing all words that are p apart, for each p; a stretch counts for its smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            k = i
            while k < n - p and words[k] == words[k + p]:
                k += 1
            length = k - i + p
            if length >= max(12, 2 * p) and not any(p % q == 0 and s <= i and i + length <= s + m for (s, m), q in found.items()):
                found[i, length] = p
            i = k
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def described(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(kept))), runs, " ".join(kept)


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_all_periods(seed):
    r = random.Random(seed)
    for _ in range(150):
        w = [r.randrange(r.choice([1, 2, 2, 3, 8])) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(4)):
            unit = [r.randrange(3) for _ in range(r.randrange(1, 12))]
            at = r.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[: r.randrange(1, 9 * len(unit) + 1)]
        assert periodic.runs_of(np.array(w, np.int32)) == brute(w), w


def test_runs_of_fibonacci_words_and_long_repeats():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.runs_of(np.array(b, np.int32)) == brute(b)
    assert periodic.runs_of(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    unit = list(range(5_000)) * 30
    assert periodic.runs_of(np.array(unit, np.int32)) == [(0, 150_000, 5_000)]
    nested = ([0] * 99 + [1]) * 400
    assert periodic.runs_of(np.array(nested, np.int32)) == sorted([(0, 40_000, 100), *((100 * k, 99, 1) for k in range(400))], key=lambda r: (r[0], r[2]))


def awkward():
    r = random.Random(5)
    made = [(i, " ".join(r.choice(["a", "b", "né", "日"]) for _ in range(r.randrange(60)))) for i in range(400)]
    made += [(1001, None), (1002, ""), (1003, " \t\n"), (None, "x " * 40), (None, "x " * 40), (5, "a b c " * 10 + "\x1c a b"), (5, "q"), (1004, "one two three four " * 500 + "end")]
    return made


@pytest.mark.parametrize("parts", [1, 5])
def test_query_rows(spark, parts):
    rows = awkward()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_runs int, words string").repartition(parts)
    got = periodic.find_runs(df, tail_hash=periodic.id_hash(F.col("doc_id")))
    want = [described(*row) for row in rows]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert sorted([(*r[:8], [tuple(x) for x in r[8]], r[9]) for r in got.collect()], key=str) == sorted([(*w, runs, kept) for w, runs, kept in want], key=str)
    assert periodic.find_runs(df.filter("false")).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = "a bb ccc\n" * 40 + "tail " + "x" * 50
    want = periodic.word_numbers(text, {})
    monkeypatch.setattr(periodic, "PIECE", 7)
    assert periodic.word_numbers(text, {}).tolist() == want.tolist()
    assert "".join(periodic.pieces(text)) == text
