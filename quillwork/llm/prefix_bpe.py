"""BPE encoding and decoding by dynamic programming over prefixes, with a token of each prefix.

The merges of a text's prefix end in one token. It is a token that the prefix ends in, and that may stand
behind the last token of what is left of the prefix; such a token is unique. So each prefix's last token is
found from those of shorter prefixes: an automaton over the vocabulary, whose suffix links lead from state to
state, gives all tokens that end at a byte, and a test on the pair of tokens picks the one. Following the
tokens back from the end gives the ids, in linear time however long a pre-token is.

The pair test undoes the merges of both tokens, last one first. While two tokens that meet at the boundary are
both there, a merge of them must not come before the merges that end them; if no such merge comes, all merges
of the joined bytes stay on their side, and the two tokens are their encoding.

Distinct pre-tokens of a slice go through the recurrence in step, a character a round, by numpy arrays: states,
last tokens and remembered pair tests. Those of over LONG bytes take the same recurrence one by one, since a round for
a few of them would cost as much as one for thousands.

Pre-tokens are those of the tokenizer file's own pre-tokenizer, in its alphabet of a character a byte; the
strings of added tokens are cut out first. What lies between two blanks is looked up in caches of bounded
size. A null text is the empty text (no ids); ids of rows may be null or repeated; texts are encoded whole;
further columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import ByteBound, bounded, map_rows, tokenizer_path

#: Bytes that a worker's caches hold each, about, and pairs of tokens whose test is remembered.
CACHE_BYTES, PAIRS = 96 << 20, 1 << 18
#: Bytes above which a pre-token is encoded by itself.
LONG = 256
#: Characters of texts that are encoded together, and of one call of the pre-tokenizer, about.
SLICE_CHARS, CALL_CHARS = 1 << 20, 1 << 16
#: A rank after all others, and the blank in the byte alphabet.
_NEVER, _BLANK = 1 << 30, "\u0120"


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: printable ones stand for themselves, the others
    for those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The pre-tokenizer whose ASCII pre-tokens ascii_pre_tokens() knows.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def ascii_pre_tokens() -> Callable[[str], list[str]]:
    """The byte-level pre-tokens of ASCII texts that are in the byte alphabet already: contractions, then runs of
    letters, of digits and of others after one blank at most, then white space but for its last before a word."""
    space = "".join(c for c, b in byte_alphabet().items() if b in b" \t\n\r\f\v")
    pattern = f"'s|'t|'re|'ve|'m|'ll|'d|{_BLANK}?[A-Za-z]+|{_BLANK}?[0-9]+|{_BLANK}?[^{space}A-Za-z0-9]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(pattern).findall


class Merges:
    """Merges of a vocabulary: the two parts of each token, and the rank at which they merge."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values()) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[x, y] = rank
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array(list(self.merged.values()), np.int64)[order]
        self.known, self.met = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        # a token that the merges of its own bytes don't give ends no prefix
        self.whole = [True] * size
        for z in sorted((z for z in range(size) if self.rank[z] >= 0), key=self.rank.__getitem__):
            x, y = self.left[z], self.right[z]
            self.whole[z] = self.whole[x] and self.whole[y] and self.meet(x, y, self.rank[z], self.rank[z])
        self.lefts, self.rights, self.ranks = (np.array(v, np.int64) for v in (self.left, self.right, self.rank))

    def meet(self, a: int, b: int, end_a: int = _NEVER, end_b: int = _NEVER) -> bool:
        """Whether no merge crosses the boundary of a and b, which merges of the given ranks end at last."""
        rank, merged = self.rank, self.merged
        while True:
            crossing = merged.get((a, b))
            # at one rank the leftmost pair merges first: one that ends b lies right of this boundary
            if crossing is not None and crossing < end_a and crossing <= end_b:
                return False
            made_a, made_b = rank[a], rank[b]
            if made_a > made_b:  # of two tokens alike the right one was made last
                a, end_a = self.right[a], made_a
            elif made_b >= 0:
                b, end_b = self.left[b], made_b
            else:
                return True

    def meet_each(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """meet of many pairs at once."""
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        end_a, end_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            key = a << 32 | b
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = self.key_ranks[spot]
            free = (self.keys[spot] != key) | (rank >= end_a) | (rank > end_b)
            made_a, made_b = self.ranks[a], self.ranks[b]
            step_a = made_a > made_b
            out[at[free & ~step_a & (made_b < 0)]] = True
            go = free & (step_a | (made_b >= 0))
            at, a, b, end_a, end_b, made_a, made_b, step_a = (v[go] for v in (at, a, b, end_a, end_b, made_a, made_b, step_a))
            a, end_a = np.where(step_a, self.rights[a], a), np.where(step_a, made_a, end_a)
            b, end_b = np.where(step_a, b, self.lefts[b]), np.where(step_a, end_b, made_b)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """meet_each, remembered in a table of PAIRS places, where a pair takes the place of another."""
        key = a << 32 | b
        spot = (key ^ (key >> 27)) * 0x2545F491 % len(self.known)
        lost = np.flatnonzero(self.known[spot] != key)
        if len(lost):
            fresh, back = np.unique(key[lost], return_inverse=True)
            met = self.meet_each(fresh >> 32, fresh & 0xFFFFFFFF)
            out = self.met[spot]
            out[lost] = met[back]
            self.known[spot[lost]] = key[lost]
            self.met[spot[lost]] = out[lost]  # of pairs with one place the last one takes both
            return out
        return self.met[spot]


class Endings:
    """Automaton over a vocabulary's tokens: after(state, byte), and of each state the longest token that what was read
    ends in. shorter: of each token the longest other token that it ends in."""

    def __init__(self, tokens: dict[bytes, int]):
        nodes: dict[int, int] = {}
        parent, byte, depth, own = [0], [0], [0], [-1]
        ends = {}
        for token, i in tokens.items():
            at = 0
            for b in token:
                key = at << 8 | b
                after = nodes.get(key)
                if after is None:
                    after = nodes[key] = len(parent)
                    parent.append(at), byte.append(b), depth.append(depth[at] + 1), own.append(-1)
                at = after
            own[at], ends[i] = i, at
        parent, byte, depth, self.longest = np.array(parent), np.array(byte), np.array(depth), np.array(own, np.int64)
        self.after = np.zeros((len(parent), 256), np.int32)
        link = np.zeros(len(parent), np.int64)
        for d in range(1, int(depth.max()) + 1):
            level = np.flatnonzero(depth == d)
            up, b = parent[level], byte[level]
            if d == 1:
                self.after[0, b] = level
            else:  # links lead to states of less depth, whose rows are done
                link[level] = self.after[link[up], b]
                none = level[self.longest[level] < 0]
                self.longest[none] = self.longest[link[none]]
            self.after[level] = self.after[link[level]]
            below = np.flatnonzero(depth == d + 1)
            self.after[parent[below], byte[below]] = below
        self.shorter = np.full(max(tokens.values()) + 1, -1, np.int64)
        for i, at in ends.items():
            self.shorter[i] = self.longest[link[at]] if link[at] else -1


class PrefixCoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        model = tokenizer["model"]
        library = Tokenizer.from_file(path)
        self.pre_tokens = library.pre_tokenizer.pre_tokenize_str
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.vocabulary = model["vocab"]
        self.merges = Merges(self.vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        alphabet = byte_alphabet()
        self.alphabet = {b: c for c, b in alphabet.items() if b < 128}
        plain = json.dumps(tokenizer["pre_tokenizer"], sort_keys=True) == json.dumps(_BYTE_LEVEL, sort_keys=True)
        self.in_ascii = ascii_pre_tokens() if plain else None
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in self.vocabulary.items() if t not in self.added}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.sizes = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)]
        self.own = {t: i.to_bytes(4, "little") for t, i in self.vocabulary.items() if t not in self.added and self.merges.whole[i]}
        self.ends = Endings({self.bytes[self.vocabulary[t]]: self.vocabulary[t] for t in self.own})
        self.widths, self.to_byte = np.array(self.sizes, np.int64), {ord(c): b for c, b in alphabet.items()}
        self.cache, self.parts = ByteBound(CACHE_BYTES), ByteBound(CACHE_BYTES)

    def code(self, word: str) -> bytes:
        """Ids of one pre-token in the byte alphabet."""
        ends, widths, state = self.ends, self.sizes, 0
        last, known = array("i", bytes(4 * len(word))), {}
        for j, b in enumerate(word.translate(self.to_byte).encode("latin-1")):
            state = int(ends.after[state, b])
            token = int(ends.longest[state])
            while (before := j - widths[token]) >= 0:
                pair = last[before], token
                if pair not in known:
                    known[pair] = self.merges.meet(*pair)
                if known[pair]:
                    break
                token = int(ends.shorter[token])
            last[j] = token
        ids, at = array("I"), len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at -= widths[last[at]]
        ids.reverse()
        return np.asarray(ids, "<u4").tobytes()

    def code_each(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens in the byte alphabet, all of which go on by a byte a round."""
        data = np.frombuffer("".join(words).translate(self.to_byte).encode("latin-1"), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        first, ordered, last = starts[order], sizes[order], np.empty(len(data), np.int64)
        active = np.searchsorted(-ordered, -np.arange(1, int(ordered[0]) + 1), side="right")
        state = np.zeros(len(words), np.int64)
        for j, k in enumerate(active.tolist()):
            at = first[:k] + j
            state = self.ends.after[state[:k], data[at]]
            token = self.ends.longest[state]
            while len(at):
                width = self.widths[token]
                before = np.maximum(at - width, 0)
                alone = width == j + 1
                good = alone.copy()
                rest = np.flatnonzero(~alone)
                good[rest] = self.merges.compatible(last[before[rest]], token[rest])
                last[at[good]] = token[good]
                bad = ~good
                at, token = at[bad], self.ends.shorter[token[bad]]
        cut, at, begin = np.zeros(len(data), bool), starts + sizes - 1, starts
        while len(at):
            cut[at] = True
            at = at - self.widths[last[at]]
            on = at >= begin
            at, begin = at[on], begin[on]
        coded = last[cut].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.add.reduceat(cut, starts, dtype=np.int64))
        out, a = [], 0
        for z in stops.tolist():
            out.append(coded[a:z])
            a = z
        return out

    def learn(self, words: list[str]) -> None:
        own, put = self.own.get, self.cache.put
        short = []
        for word in words:
            if (ids := own(word)) is not None:
                put(word, ids)
            elif len(word) > LONG:
                put(word, self.code(word))
            else:
                short.append(word)
        for word, ids in zip(short, self.code_each(short) if short else (), strict=True):
            put(word, ids)

    def find(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens, in the byte alphabet; long texts in several calls, which
        are cut at a blank between two characters that aren't white space, where a pre-token begins anyway."""
        if self.in_ascii and text.isascii():
            return self.in_ascii(text.translate(self.alphabet))
        found, at = [], 0
        while len(text) - at > 2 * CALL_CHARS and (cut := _SINGLE_BLANK.search(text, at + CALL_CHARS)):
            found += [w for w, _ in self.pre_tokens(text[at : cut.start()])]
            at = cut.start()
        return found + [w for w, _ in self.pre_tokens(text[at:])] if at < len(text) else found

    def find_each(self, words: list[str]) -> list[list[str]]:
        """Pre-tokens of each of several strings without blanks, with a blank before each: in a row, as every blank
        begins one."""
        out: list[list[str]] = []
        for w in self.find(" " + " ".join(words)) if words else ():
            if w[0] == _BLANK:
                out.append([w])
            else:
                out[-1].append(w)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, part, size = [], [], 0
        for t in texts:  # caches are looked after every SLICE_CHARS, and once more after a longer text
            part.append(t)
            size += len(t)
            if size > SLICE_CHARS:
                out += self._with_added(part)
                part, size = [], 0
        return out + (self._with_added(part) if part else [])

    def _with_added(self, texts: list[str]) -> list[bytes]:
        if not any(a in t for t in texts for a in self.added):
            return self._plain(texts)
        cut = [[p for p in self.cut.split(t) if p is not None] for t in texts]
        coded = iter(self._plain([p for c in cut for p in c if p not in self.added]))
        return [b"".join(self.added[p].to_bytes(4, "little") if p in self.added else next(coded) for p in c) for c in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """A blank between two characters that aren't white space always begins a pre-token: what lies between
        such blanks is cut into pre-tokens once and remembered; other texts are cut whole."""
        self.cache.fit()
        self.parts.fit()
        cut = [t.split(" ") for t in texts]
        fresh = set(self.parts.missing(set().union(*(c[1:] for c in cut))))
        good = {w for w in fresh if bounded(w)}
        bad = fresh - good
        whole = [not bounded(c[0]) or (bool(bad) and not bad.isdisjoint(c[1:])) for c in cut]
        found = [self.find(t if w else c[0]) for t, c, w in zip(texts, cut, whole, strict=True)]
        inside = {}
        for kind in ([w for w in good if w.isascii()], [w for w in good if not w.isascii()]):
            inside.update(zip(kind, self.find_each(kind), strict=True))
        self.learn(self.cache.missing(set().union(*found, *inside.values())))
        get, part = self.cache.held.__getitem__, self.parts.held.__getitem__
        for w, f in inside.items():
            self.parts.put(w, b"".join(map(get, f)))
        return [b"".join(map(get, f)) if w else b"".join((*map(get, f), *map(part, c[1:]))) for f, c, w in zip(found, cut, whole, strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(1)
def prefix_coder(path: str) -> PrefixCoder:
    """One a worker process, kept over its tasks."""
    return PrefixCoder(path)


def encode_by_prefixes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id, n_tokens long, ids_sha256 string, decoded_sha256 string[, ids binary: 32-bit little-endian]).

    path: a tokenizer file of byte-level BPE that every executor can open. Strings of its added tokens inside a
    text are those tokens. decoded_sha256 is of the UTF-8 of the text that the ids decode to.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def start():
        coder = prefix_coder(path)

        def make(texts):
            coded = coder.encode(texts)
            sums = [len(c) // 4 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded], [hashlib.sha256(coder.decode(c).encode()).hexdigest() for c in coded]
            return [*sums, coded] if with_ids else list(sums)

        return make

    return map_rows(df, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, start)
