"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Distinct pre-tokens are bucketed by byte length into matrices, one row each. Each round looks up the
rank of every adjacent pair in a hashed pair table, every row merges its leftmost pair of minimum
rank, and rows are compacted; rows without a pair that merges leave the matrix. A bounded cache
keeps the ids of pre-tokens that were met before.

A null text is the empty text (no ids); ids may be null or repeated; every text is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import ByteBound, bounded, map_rows, pretoken_pattern, rank_table, tokenizer_path

#: Bytes that a worker's two caches, of pre-tokens and of what stands between blanks, hold each, about.
CACHE_BYTES = 128 << 20
#: Cells of one matrix at most, and bytes above which a pre-token is merged from a heap instead.
CELLS, LONG = 1 << 20, 2048
#: Characters of texts that are encoded together, about.
SLICE_CHARS = 1 << 20
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, in an open-addressing table held by numpy arrays.

    The merged id is also the rank: ranks and ids are the same in rank files. A pair is listed when
    the two tokens' bytes, joined, are a token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, _NONE)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = self.keys[slot[left_over]] == np.uint64(2**64 - 1)
            taker = left_over[free]
            _, first = np.unique(slot[taker], return_index=True)
            won = taker[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left_over = np.setdiff1d(left_over, won, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        slot, out, todo = self._slot(keys), np.full(len(keys), _NONE), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo = todo[on]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.tokens = {i: t for t, i in ranks.items()}
        self.cache, self.parts = ByteBound(CACHE_BYTES), ByteBound(CACHE_BYTES)

    def _matrix(self, words: list[bytes], length: int) -> list[np.ndarray]:
        """Ids of words of at most this many bytes, all of them merged in step."""
        n = len(words)
        raw = np.zeros((n, length), np.uint8)
        sizes = np.array([len(w) for w in words])
        raw[np.arange(length)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids, rows, out = self.byte_id[raw], np.arange(n), [None] * n
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rank[np.arange(length - 1)[None, :] >= (sizes - 1)[:, None]] = _NONE
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : sizes[k]].copy()
                keep = ~done
                ids, rank, rows, sizes, at, best = ids[keep], rank[keep], rows[keep], sizes[keep], at[keep], best[keep]
                if not len(rows):
                    break
                widest = int(sizes.max())
                ids, rank = ids[:, :widest], rank[:, : widest - 1]
            r = np.arange(len(rows))
            ids[r, at] = best
            # compaction: what stands right of the merged pair moves left by one
            cols = np.arange(ids.shape[1])
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1), axis=1)
            pair_cols = np.arange(rank.shape[1])
            rank = np.take_along_axis(rank, np.minimum(pair_cols + (pair_cols > at[:, None]), rank.shape[1] - 1), axis=1)
            sizes = sizes - 1
            for side in (at - 1, at):  # only the two pairs that touch the merged token are new
                k = np.flatnonzero((side >= 0) & (side < sizes - 1))
                if len(k):
                    rank[k, side[k]] = self.pairs.get(ids[k, side[k]], ids[k, side[k] + 1])
            rank[pair_cols[None, :] >= (sizes - 1)[:, None]] = _NONE
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """One very long pre-token: the leftmost pair of minimum rank from a heap over linked positions."""
        import heapq

        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != _NONE)]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = ids[i], ids[j]
                if pair not in known:
                    known[pair] = int(self.pairs.get(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] != _NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32)

    def learn(self, words: Iterable[str]) -> None:
        """Encode pre-tokens that the cache lacks, bucketed by length (exact up to 16 bytes, then powers of two)."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self.cache.put(word, whole.to_bytes(4, "little"))
            else:
                buckets.setdefault(len(data) if len(data) <= 16 else 1 << (len(data) - 1).bit_length(), []).append((word, data))
        for members in buckets.values():
            length = max(len(d) for _, d in members)
            if length > LONG:
                for word, data in members:
                    self.cache.put(word, self._long(data).astype("<u4").tobytes())
                continue
            step = max(1, CELLS // length)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for (word, _), ids in zip(part, self._matrix([d for _, d in part], length), strict=True):
                    self.cache.put(word, ids.astype("<u4").tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A blank between two characters that aren't white space always begins a pre-token: what lies
        between such blanks is cut into pre-tokens once and remembered; other texts are cut whole.
        """
        out, part, size = [], [], 0
        for t in texts:  # caches are looked after every SLICE_CHARS, and once more after a longer text
            part.append(t)
            size += len(t)
            if size > SLICE_CHARS:
                out += self._encode(part)
                part, size = [], 0
        return out + (self._encode(part) if part else [])

    def _encode(self, texts: list[str]) -> list[bytes]:
        self.cache.fit()
        self.parts.fit()
        cut = [t.split(" ") for t in texts]
        fresh = set(self.parts.missing(set().union(*(c[1:] for c in cut))))
        good = {w for w in fresh if bounded(w)}
        bad = fresh - good
        whole = [not bounded(c[0]) or (bool(bad) and not bad.isdisjoint(c[1:])) for c in cut]
        found = [self.find(t) if w else self.find(c[0]) for t, c, w in zip(texts, cut, whole, strict=True)]
        inside = {w: self.find(" " + w) for w in good}
        self.learn(self.cache.missing(set().union(*found, *inside.values())))
        get, part = self.cache.held.__getitem__, self.parts.held.__getitem__
        for w, f in inside.items():
            self.parts.put(w, b"".join(map(get, f)))
        return [b"".join(map(get, f)) if w else b"".join((*map(get, f), *map(part, c[1:]))) for f, c, w in zip(found, cut, whole, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        get = self.tokens.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process, kept over its tasks."""
    return Encoder(rank_table(path), pattern)


def encode_bpe(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id, n_tokens long, ids_sha256 string, decoded_sha256 string[, ids binary: 32-bit little-endian]).

    ranks_path: a rank file that every executor can open. Special tokens aren't recognised: their
    strings are ordinary text. decoded_sha256 is of the bytes that the ids decode to, which are the
    text's UTF-8 again.
    """
    path = ranks_path or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or pretoken_pattern()

    def start():
        coder = encoder(path, pattern)

        def make(texts):
            coded = coder.encode(texts)
            sums = [len(c) // 4 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded], [hashlib.sha256(coder.decode(c)).hexdigest() for c in coded]
            return [*sums, coded] if with_ids else list(sums)

        return make

    return map_rows(df, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, start)
