"""Token counts of a unigram model by trie-shared dynamic programming.

A text is cut into pre-tokens at white space; each carries the word-start mark U+2581. Distinct
pre-tokens are inserted in a trie; a node's forward score (the best sum of piece log-probabilities
over the node's string, and with it the fewest pieces among equals) is computed once, from its
ancestors, for all pre-tokens that share the prefix. Terminal nodes store their piece count, and a
text's count is the sum over its pre-tokens.

Pieces come from a public vocabulary; its order gives the log-probabilities by Zipf's law, since the file
holds no unigram scores and tokenizers aren't trained here (fitting them by expectation and maximisation
would be training one). A character that no piece covers costs its UTF-8 bytes, one token each.

A null text is the empty text: no tokens. Ids may be null or repeated. Texts are counted whole.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows, tokenizer_path

#: Trie nodes that a worker keeps, about 250 bytes each; the trie is emptied when it is full. Characters of
#: texts that are inserted before it is looked after: one longer text is inserted by itself.
NODES, SLICE_CHARS = 700_000, 1 << 20
#: Log-probability of one byte of a character outside the vocabulary.
BYTE_SCORE = -25.0
MARK = "▁"


def zipf_pieces(path: str) -> dict[str, float]:
    """Piece -> log-probability: the k-th piece in order has a share in proportion to 1 / (k + 2.7)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (k + 2.7) for k in range(len(names))))
    return {name: -math.log(k + 2.7) - total for k, name in enumerate(names)}


class TrieCounter:
    """children[node]: character -> node; best[node]: (score, pieces) of the path's string."""

    def __init__(self, pieces: dict[str, float]):
        # every string that ends a piece, with the log-probability of those that are pieces themselves
        self.endings: dict[str, float | None] = {}
        for piece in pieces:
            for at in range(1, len(piece)):
                self.endings.setdefault(piece[at:])
            self.endings[piece] = pieces[piece]
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {"": 0}

    def insert(self, word: str) -> int:
        node, path, text, ending = 0, [0], MARK + word, self.endings.get
        for depth, c in enumerate(text, 1):
            nxt = self.children[node].get(c)
            if nxt is None:
                nxt = len(self.children)
                self.children[node][c] = nxt
                self.children.append({})
                n = len(c.encode("utf-8", "surrogatepass"))
                best, pieces = self.score[node] + BYTE_SCORE * n, self.count[node] + n
                for begin in range(depth - 1, -1, -1):
                    p = ending(text[begin:depth], 0)
                    if p == 0:
                        break  # no piece ends in this string, nor in a longer one
                    if p is not None:
                        back = path[begin]
                        s, k = self.score[back] + p, self.count[back] + 1
                        if s > best or (s == best and k < pieces):
                            best, pieces = s, k
                self.score.append(best)
                self.count.append(pieces)
            node = nxt
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        out, part, size = ([], []), [], 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size > SLICE_CHARS or i == len(texts) - 1:
                for o, made in zip(out, self._counts(part), strict=True):
                    o += made
                part, size = [], 0
        return out

    def _counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        if len(self.children) > NODES:
            self.clear()
        words = [t.split() for t in texts]
        for w in sorted(set().union(*words).difference(self.terminal) if words else ()):
            self.insert(w)
        get = self.terminal.__getitem__
        return [len(w) for w in words], [sum(map(get, w)) for w in words]


@lru_cache(1)
def trie_counter(path: str) -> TrieCounter:
    """One a worker process, kept over its tasks."""
    return TrieCounter(zipf_pieces(path))


def brute_count(text: str, pieces: dict[str, float]) -> int:
    """Each pre-token by itself, over all piece boundaries; for tests."""
    total = 0
    for word, times in Counter(text.split()).items():
        s = MARK + word
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for end in range(1, len(s) + 1):
            n = len(s[end - 1].encode("utf-8", "surrogatepass"))
            best[end] = (best[end - 1][0] + BYTE_SCORE * n, best[end - 1][1] + n)
            for begin in range(end - 1, -1, -1):
                p = pieces.get(s[begin:end])
                if p is not None:
                    x = (best[begin][0] + p, best[begin][1] + 1)
                    if x[0] > best[end][0] or (x[0] == best[end][0] and x[1] < best[end][1]):
                        best[end] = x
        total += best[-1][1] * times
    return total


def count_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model_path: str | None = None) -> DataFrame:
    """(id, n_pretokens long, n_tokens long), one row a row."""
    path = model_path or tokenizer_path("piece_bpe_32k.model")

    def start():
        counter = trie_counter(path)
        return lambda texts: list(counter.counts(texts))

    return map_rows(df, [id_col], text_col, "n_pretokens long, n_tokens long", start)
