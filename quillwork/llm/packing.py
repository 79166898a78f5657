"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are token streams, queued by source. Every window of WINDOW tokens gives each queue its
target share; what rounding leaves a queue short is its deficit and is carried on, so that after k
windows of a phase a queue has been served exactly the k-fold share, rounded down. The deficit
recurrence has a closed form (floors of cumulative shares), hence any window can be served anywhere:
a partition needs its documents' positions in their queue, not the windows before. When a queue runs dry a new phase begins, with the targets of the others scaled up.

Without targets a queue's target is its part of all tokens. A source that would be due less than a
sequence a window then, and has no target of its own, joins the queue of all such sources, where their
documents are mixed evenly by a hash: its deficit would otherwise be paid out in pieces of a token or
so. There are at most WINDOW / SEQUENCE other queues beside those with targets, however many sources.

Windows are laid end to end and cut into sequences of 2048, all full but the last. Documents are cut
where a queue's share or a sequence ends, so each token lies in exactly one piece.

Positions in a queue come from sums by (queue, block), blocks of bounded rows, running sums over blocks
in two levels, and a running sum within a block: no source is ever in one task. Null text is the empty
text (one token: the end id), null source is a source named by the empty string, null or repeated ids
keep a row each, further columns don't matter; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, crc, map_rows, pretoken_pattern, rank_table, tokenizer_path, written

SEQUENCE, WINDOW, END_ID = 2048, 1 << 17, 1
#: Documents in a block of a queue, about, and blocks that one running sum covers.
BLOCK_ROWS, SUM_BLOCKS = 5_000, 4_096
#: Bytes of ids in one batch of pieces, about; the name of the queue that small sources share.
OUT_BYTES, SHARED = 1 << 23, "+"
#: Characters up to which a text is encoded from ranks.
RANKED_CHARS = 200_000


class TextCoder:
    """Ids of whole texts, as the tokenizers library gives them with add_special_tokens=False: the string of
    an added token inside a text is that token.

    Texts without one are encoded from the ranks of the same vocabulary, which gives the same ids several
    times faster (tests compare them, by every code point too); very long ones aren't, whose runs of white
    space would take that library's stack.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=rank_table(ranks_path), special_tokens={})
        self.code, self.dtype = id_type(self.coder.get_vocab_size())

    def encode(self, text: str) -> bytes:
        """Ids in the type dtype."""
        if len(text) > RANKED_CHARS or any(t in text for t in self.added):
            return array(self.code, self.coder.encode(text, add_special_tokens=False).ids).tobytes()
        return array(self.code, self.ranked.encode_ordinary(text)).tobytes()


def id_type(vocabulary: int) -> tuple[str, str]:
    """Codes of the narrowest type that ids are kept in."""
    return ("H", "<u2") if vocabulary <= 1 << 16 else ("I", "<u4")


def vocabulary_size(path: str) -> int:
    """Of a tokenizer file, without a tokenizer in the driver."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    return len(made["model"]["vocab"].keys() | {t["content"] for t in made["added_tokens"]})


@lru_cache(1)
def text_coder(path: str, ranks_path: str, pattern: str) -> TextCoder:
    """One a worker process, kept over its tasks; it remembers no texts."""
    return TextCoder(path, ranks_path, pattern)


def public_coder() -> tuple[str, str, str]:
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern()


class Phase:
    """Windows over which the queues served stay the same.

    first: place of the phase's first token; shares: tokens of each queue in this phase; begun: tokens
    of each queue served before. After k windows a queue has been served its k-fold share, rounded down:
    what a window lacks of WINDOW tokens by that, one a queue at most, the next ones make up for.
    """

    def __init__(self, first: int, begun: dict[str, int], shares: dict[str, int], window: int = WINDOW):
        self.first, self.begun, self.total, self.window = first, begun, sum(shares.values()), window
        self.shares, self.order = shares, sorted(shares)
        self.windows = -(-self.total // window)
        self.places: dict[int, dict[str, int]] = {}

    def served(self, q: str, k: int) -> int:
        """Tokens of queue q in the phase's first k windows."""
        return min(k * self.window, self.total) * self.shares[q] // self.total

    def place(self, q: str, k: int) -> int:
        """Where queue q's tokens of window k begin."""
        if k not in self.places:
            if len(self.places) > 256:
                self.places.clear()
            at, found = self.first + sum(self.served(p, k) for p in self.order), {}
            for p in self.order:
                found[p] = at
                at += self.served(p, k + 1) - self.served(p, k)
            self.places[k] = found
        return self.places[k][q]


def plan(totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW) -> list[Phase]:
    """Phases that serve all tokens. Without targets a queue's share is its part of all tokens, and all
    queues end together; queues without a target come by that rule when those with one are empty."""
    left = {q: n for q, n in totals.items() if n}
    at, begun, phases = 0, dict.fromkeys(totals, 0), []

    def serve(shares: dict[str, int]) -> None:
        nonlocal at
        phase = Phase(at, dict(begun), shares, window)
        phases.append(phase)
        at += phase.total
        for q, n in shares.items():
            begun[q] += n
            left[q] -= n
            if not left[q]:
                del left[q]

    while left:
        if targets is None:
            serve(dict(left))
            continue
        weight = {q: max(targets.get(q, 0.0), 0.0) for q in left}
        if not sum(weight.values()):
            weight = dict(left)
        active = {q: w / sum(weight.values()) for q, w in weight.items() if w}
        first = min(active, key=lambda q: left[q] / active[q])
        scale = left[first] / active[first]
        shares = {q: left[q] if q == first else min(left[q], int(scale * w)) for q, w in active.items()}
        serve({q: n for q, n in shares.items() if n})
    return phases


def pieces_of(phases: list[Phase], q: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, place) of the tokens start to end of queue q, cut at windows."""
    for p in phases:
        if q not in p.shares:
            continue
        lo, hi = max(start - p.begun[q], 0), min(end - p.begun[q], p.shares[q])
        if lo >= hi:
            continue
        k = min(p.windows - 1, lo * p.total // (p.shares[q] * p.window))
        while k and p.served(q, k) > lo:
            k -= 1
        while p.served(q, k + 1) <= lo:
            k += 1
        while lo < hi:
            a, b = p.served(q, k), p.served(q, k + 1)
            to = min(hi, b)
            if to > lo:
                yield p.begun[q] + lo, p.begun[q] + to, p.place(q, k) + lo - a
                lo = to
            k += 1


def tokenized(df: DataFrame, text_col: str, id_col: str, source_col: str, coder_files: tuple[str, str, str]) -> DataFrame:
    """(doc_id, queue, n, ids binary): ids with the end id, in the coder's type."""
    given = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), F.col(text_col).alias("text"))

    def start():
        coder = text_coder(*coder_files)
        end = np.array([END_ID], coder.dtype).tobytes()

        def make(texts):
            ids = [coder.encode(t) + end for t in texts]
            return [[len(x) // len(end) for x in ids], ids]

        return make

    return map_rows(given, ["doc_id", "queue"], "text", "n long, ids binary", start)


def queues(coded: DataFrame, targets: dict[str, float] | None, window: int) -> DataFrame:
    """coded with the names of queues, null for the one that the small sources share."""
    totals = coded.groupBy("queue").agg(F.sum("n").alias("n"))
    share = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * SEQUENCE // window
    wanted = [q for q, w in (targets or {}).items() if w > 0]
    own = [r["queue"] for r in totals.filter((F.col("n") >= max(share, 1)) | F.col("queue").isin(wanted)).collect()]  # WINDOW / SEQUENCE and len(targets) rows at most
    missing = set(wanted).difference(own)
    if missing and len(missing) == len(wanted):
        raise ValueError(f"no documents of the sources with targets: {sorted(missing)}")
    return coded.withColumn("queue", F.when(F.col("queue").isin(own), F.col("queue")))


def block_bases(rows: DataFrame) -> DataFrame:
    """(queue, block, sum, base) of rows (queue, block, n): base is the sum of the queue's blocks before."""
    sums = written(rows.groupBy("queue", "block").agg(F.sum("n").alias("sum")).withColumn("part", F.expr(f"block div {SUM_BLOCKS}")), narrow=True)
    parts = sums.groupBy("queue", "part").agg(F.sum("sum").alias("all"))
    parts = parts.withColumn("before", F.sum("all").over(Window.partitionBy("queue").orderBy("part")) - F.col("all"))
    inside = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("queue", "part").orderBy("block")) - F.col("sum"))
    joined = inside.alias("i").join(parts.alias("p"), F.col("i.queue").eqNullSafe(F.col("p.queue")) & (F.col("i.part") == F.col("p.part")))
    return written(joined.select("i.queue", "block", "sum", (F.col("base") + F.col("before")).alias("base")), narrow=True)


def pack(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", coder_files: tuple[str, str, str] | None = None, targets: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: long; ids binary), a row a piece;
    ids are little-endian unsigned 32-bit. coder_files: a tokenizer file and a rank file of its vocabulary,
    which every executor can open, and the pattern of pre-tokens (public_coder() if None). targets: weights of sources; sources without one come when those with one are empty. window: tokens of a window,
    a multiple of a sequence."""
    coder_files = coder_files or public_coder()
    _, dtype = id_type(vocabulary_size(coder_files[0]))
    # a number for each row, fixed once it is written: blocks are even whatever ids are null or repeated
    coded = written(tokenized(df, text_col, id_col, source_col, coder_files).withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, -(-coded.count() // BLOCK_ROWS))
    rows = queues(coded, targets, window).withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)))
    bases = block_bases(rows)
    totals = {r["queue"]: r["total"] for r in bases.groupBy("queue").agg(F.sum("sum").alias("total")).collect()}  # one row a queue
    phases = plan({_name(q): n for q, n in totals.items()}, targets and {_name(q): w for q, w in targets.items()}, window)
    # a block's base travels as a row in front of its documents, so that one shuffle brings both together
    first = bases.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "queue", "block", "base", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("binary").alias("ids"))
    both = first.unionByName(rows.select("doc_id", "queue", "block", F.lit(None).cast("long").alias("base"), "n", "row", "ids"))
    given = both.repartition("queue", "block").sortWithinPartitions("queue", "block", F.col("base").isNull(), "doc_id", "row")
    given = given.select("doc_id", "queue", "base", "n", "ids")
    out = given.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], "ids").schema
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            found, size = [], 0
            for doc, q, base, n, ids in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if base is not None:
                    at = base
                    continue
                q, ids = _name(q), np.frombuffer(ids.as_buffer(), dtype)
                for a, b, place in pieces_of(phases, q, at, at + n):
                    for x, y in pairwise(_cuts(a, b, place)):
                        part = ids[x - at : y - at].astype("<u4").tobytes()
                        found.append((doc, x - at, y - x, crc(part), n, (place + x - a) // SEQUENCE, (place + x - a) % SEQUENCE, part))
                        size += len(part)
                at += n
                if size > OUT_BYTES:
                    yield _batch(found, arrow)
                    found, size = [], 0
            if found:
                yield _batch(found, arrow)

    return given.mapInArrow(run, out)


def _name(queue: str | None) -> str:
    """Names in a plan: sources behind a mark, so that the shared queue's name is no source's."""
    return SHARED if queue is None else f"={queue}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _cuts(a: int, b: int, place: int) -> list[int]:
    """a, b and what lies between where a sequence ends, for tokens laid from place on."""
    first = a + SEQUENCE - place % SEQUENCE
    return [a, *range(first, b, SEQUENCE), b]
