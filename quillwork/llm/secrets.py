"""Secret scans with a combined deterministic automaton.

Every rule's regex is compiled by subset construction and minimisation into transition arrays; one
pass over a text's bytes scans for all rules. The base kinds (assign, access, hex) are leftmost,
non-overlapping matches per kind, of which those that are too short drop; further rules add spans.

A null text is the empty text and has no spans. Ids may be null or repeated; every row has its own
result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Scanner, _Parser, fold_case
from .common import map_rows

#: Kinds in the order in which spans that start together are listed: the base ones, then the added ones.
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """keyword (letters in either case) is followed by pattern; a match passes if keep finds it in the text."""

    kind: str
    pattern: str
    keyword: str = ""
    keep: str = ""


#: hex carries its least length in the regex (a run that is too short holds no longer one). The others
#: check lengths afterwards: counted loops that overlap would multiply the automaton's states.
RULES = (
    Rule("assign", r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"(password|passwd|secret|token|api_?key)", r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", keep=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]+", keep=r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", keep=r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", keep=r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


class SecretScanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.kinds = [r.kind for r in rules]
        trees = []
        for r in rules:
            rest = _Parser(r.pattern).parse()
            trees.append(("cat", fold_case(_Parser(r.keyword).parse()), rest) if r.keyword else rest)
        self.scanner = Scanner(trees)
        self.keep = [re.compile(r.keep.encode()) if r.keep else None for r in rules]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start and then kind as listed."""
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for k, (kind, hits, keep) in enumerate(zip(self.kinds, self.scanner.scan(data), self.keep, strict=True)):
            for a, b in hits:
                if keep is None or self._passes(keep, data, a, b):
                    found.append((a, k, b, kind))
        if not found:
            return []
        found.sort()
        if len(data) == len(text):
            return [(a, b, kind) for a, _, b, kind in found]
        place, done, count = {}, 0, 0
        for at in sorted({x for a, _, b, _ in found for x in (a, b)}):
            count += len(data[done:at].decode("utf-8", "surrogatepass"))
            place[at], done = count, at
        return [(place[a], place[b], kind) for a, _, b, kind in found]

    @staticmethod
    def _passes(keep: re.Pattern, data: bytes, a: int, b: int) -> bool:
        """The first place where keep can begin decides: later separators are part of the value."""
        first = re.search(rb"[:=]", data[a:b]) if keep.pattern.startswith(b"[:=]") else None
        return keep.match(data, a + (first.start() if first else 0), b) is not None


def find_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, found array<struct<start int, end int, kind string>>), one row a row."""

    def start():
        scanner = SecretScanner(rules)
        return lambda texts: [[[{"start": a, "end": b, "kind": k} for a, b, k in scanner.spans(t)] for t in texts]]

    return map_rows(df, [id_col], text_col, "found array<struct<start:int,end:int,kind:string>>", start)


def secret_digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex long, base_sha256, spans string) from find_secrets."""

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    found = find_secrets(df, text_col, id_col)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, each secret in the text column replaced by ``[kind]``; overlapping
    spans are replaced as one, named by the first. A null text stays null."""

    def start():
        scanner = SecretScanner(rules)

        def clean(text):
            if text is None:
                return None
            out, done = [], 0
            for a, b, kind in scanner.spans(text):
                if a >= done:
                    out += [text[done:a], f"[{kind}]"]
                done = max(done, b)
            return "".join([*out, text[done:]]) if out else text

        return lambda texts: [[clean(t) for t in texts]]

    return _redacted(df, text_col, start)


def _redacted(df, text_col, start):
    """map_rows keeps the other columns by position, so their names don't matter."""
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    others = [c for i, c in enumerate(renamed.columns) if i != at]
    made = map_rows(renamed, others, f"c{at}", "clean string", start, text_null=True)
    order = [f"c{i}" if i != at else "clean" for i in range(len(names))]
    return made.select(*order).toDF(*names)
