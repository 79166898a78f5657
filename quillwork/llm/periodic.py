"""Periodic runs of words: maximal stretches that repeat with a period, by harmonic grid probing.

For each period p only the words at jp and (j+1)p are compared, n/p pairs and n log n in all: a run of period
p that is at least 2p long holds such a pair. Pairs that are equal, and have an equal neighbour, are extended
to both sides by chunked comparison of word numbers. Grid points inside a run that was found already are
skipped where its period divides p, as all of the run repeats with p then, and so are those inside a stretch
that was just compared. What is left has p for its smallest period: a smaller one would divide p and its run
would have been found before.

Words of a slice of texts are numbered by equality and laid end to end with a number of its own between two
texts, so that one grid serves the texts of a slice; texts of over SLICE_WORDS words have one for themselves.
Texts are read in pieces of PIECE characters, so that beside a text and its distinct words a task holds a few
bytes a word. A null text has no words; null ids count as the empty text where they are hashed, null or
repeated ids keep a row each; further columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: A run has this many words at least.
LEAST = 12
#: Words of texts that share a grid, about, and characters that are cut into words at once.
SLICE_WORDS, PIECE = 1 << 16, 1 << 20
#: Words compared at once when a stretch is extended, at first and at most.
CHUNK, WIDEST = 32, 1 << 16
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def pieces(text: str) -> Iterator[str]:
    """The text cut at white space into pieces of about PIECE characters, unless a word is longer."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            cut = _BLANK.search(text, at + PIECE)
            end = cut.end() if cut else end
        yield text[at:end]
        at = end


def word_numbers(text: str, numbers: dict[str, int]) -> np.ndarray:
    """A number for each word, equal for equal words; new words get the next ones in numbers."""
    parts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in _WORDS.findall(p)), np.int32) for p in pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _reach(w: np.ndarray, i: int, p: int, step: int) -> int:
    """The last k from i on, in the direction step, such that w[k] == w[k + p] for all between."""
    size = CHUNK
    while True:
        if step > 0:
            a = w[i + 1 : i + 1 + size]
            b = w[i + 1 + p : i + 1 + p + size]
            same = a[: len(b)] == b
        else:
            lo = max(i - size, 0)
            same = (w[lo:i] == w[lo + p : i + p])[::-1]
        if not same.all():
            return i + step * int(same.argmin())
        i += step * len(same)
        if len(same) < size:
            return i
        size = min(2 * size, WIDEST)


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbers, by start and then period; each is maximal, its period the
    smallest, and its length LEAST and two periods at least."""
    n, found = len(w), []
    open_runs: list[tuple[int, int, int]] = []  # runs of more than p words: no other holds two words p apart
    for p in range(1, n // 2 + 1):
        hits = np.flatnonzero(w[: n - p : p] == w[p::p])
        if not len(hits):
            continue
        hits = hits * p
        # five more pairs beside this one are needed at least, hence a neighbour
        beside = w[np.minimum(hits + 1, n - 1)] == w[np.minimum(hits + 1 + p, n - 1)]
        beside &= hits + 1 + p < n
        before = np.maximum(hits - 1, 0)
        beside |= (hits > 0) & (w[before] == w[before + p])
        hits = hits[beside]
        if not len(hits):
            continue
        if open_runs:
            open_runs = [r for r in open_runs if r[1] - r[0] > p]
            for start, end, q in open_runs:
                if p % q == 0:
                    lo, hi = np.searchsorted(hits, (start, end - p))
                    if lo < hi:
                        hits = np.concatenate((hits[:lo], hits[hi:]))
        passed = -1
        for i in hits.tolist():
            if i <= passed:
                continue
            first, passed = _reach(w, i, p, -1), _reach(w, i, p, 1)
            length = passed - first + 1 + p
            if length >= max(LEAST, 2 * p):
                found.append((first, length, p))
                open_runs.append((first, first + length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_many(texts: list[np.ndarray], numbers: int) -> list[list[tuple[int, int, int]]]:
    """runs_of each text, by one grid over all of them: numbers from numbers on stand between texts."""
    parts, starts, at = [], [], 0
    for k, w in enumerate(texts):
        starts.append(at)
        parts += [w, np.array([numbers + k], np.int32)]
        at += len(w) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if at:
        for start, length, period in runs_of(np.concatenate(parts)):
            k = bisect_right(starts, start) - 1
            out[k].append((start - starts[k], length, period))
    return out


def repeated_tail(w: np.ndarray, h: int) -> np.ndarray:
    """w with its tail replaced by repetitions, where h, a hash of the text's id, is a multiple of ten."""
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((w[:a], w[a + np.arange(n - a) % p]))


def collapsed(w: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """w without the words that a run holds after its first period."""
    drop = np.zeros(len(w) + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return w[np.cumsum(drop)[:-1] == 0]


class Finder:
    def __init__(self, with_texts: bool):
        self.with_texts = with_texts

    def find(self, texts: list[str], hashes: list[int]) -> list[tuple]:
        out, held, size, numbers = [], [], 0, {}
        for text, h in zip(texts, hashes, strict=True):
            w = repeated_tail(word_numbers(text, numbers), h)
            held.append(w)
            size += len(w)
            if size > SLICE_WORDS:
                out += self._described(held, numbers)
                held, size, numbers = [], 0, {}
        return out + self._described(held, numbers)

    def _described(self, texts: list[np.ndarray], numbers: dict[str, int]) -> list[tuple]:
        words, out = list(numbers), []
        for w, runs in zip(texts, runs_of_many(texts, len(numbers)), strict=True):
            kept, sums, kept_text = collapsed(w, runs), hashlib.sha256(), []
            for at in range(0, len(kept), SLICE_WORDS):
                part = (" " if at else "") + " ".join(map(words.__getitem__, kept[at : at + SLICE_WORDS].tolist()))
                sums.update(part.encode("utf-8", "surrogatepass"))
                if self.with_texts:
                    kept_text.append(part)
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            listed = hashlib.sha256()
            for r in runs:
                listed.update(b"%d,%d,%d\n" % r)
            row = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), listed.hexdigest(), sums.hexdigest())
            out.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "".join(kept_text)) if self.with_texts else row)
        return out


def find_runs(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tail_hash: Column | None = None, with_texts: bool = True) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli: long; runs_sha256, collapsed_sha256: string[, runs:
    array<struct<start, length, period: long>>, collapsed: string]).

    start to exponent_milli are of the longest run (of those the first, then of least period), null without one.
    runs_sha256 digests the lines `start,length,period` of all runs; collapsed is the text's words without what
    repeats within a run, joined by a blank. tail_hash: a long by row; where ten divides it, the words from some
    place on are replaced by repetitions before anything else (repeated_tail); none are if it is None.
    """
    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_texts:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    width = schema.count(", ") + 1
    # the hash travels in front of the text, parted by a blank
    given = df.select(F.col(id_col), F.concat((F.lit(1) if tail_hash is None else tail_hash).cast("string"), F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__words"))

    def start() -> Callable:
        finder = Finder(with_texts)

        def make(texts: list[str]) -> list[list]:
            parted = [t.partition(" ") for t in texts]
            rows = finder.find([t for *_, t in parted], [int(h) for h, *_ in parted])
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]

        return make

    return map_rows(given, [id_col], "__words", schema, start)


def id_hash(id_col: Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
