"""Exact dedup with a minimal perfect hash over historical distinct digests.

Texts are equal when identical after lower-casing A-Z only. The distinct digests of the history are
dealt into shards by their first bits; each shard gets a minimal perfect hash (bucket displacements
found by trial, largest bucket first) whose slots hold the full 32-byte digest and the winner's
locator. Further rows, already summed by digest, look their slot up and compare all 32 bytes:
members join the historical group, nonmembers form groups of their own.

Rows are summed by digest before any shuffle (a hot group is one row a task), shards are bounded by
the number of shards, and what a row gets comes by an equi-join on the digest, which is unique on
one side. Null text is the empty text; a null id never wins against another; of repeated ids each
row stays. A group of null ids only has no row that stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, written

#: Distinct digests that one shard of the hash should hold, and mean keys in one of its buckets.
SHARD_KEYS, BUCKET_KEYS = 200_000, 4
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: n keys to n slots, one displacement a bucket."""

    def __init__(self, digests: np.ndarray):
        """digests: n x 32 bytes."""
        self.n = len(digests)
        self.buckets = max(1, self.n // BUCKET_KEYS)
        self.shift = np.zeros(self.buckets, np.uint32)
        words = np.ascontiguousarray(digests).view("<u8").reshape(self.n, 4)
        bucket = (words[:, 1] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(self.n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            keys = words[order[starts[b] : starts[b + 1]]]
            if sizes[b] == 1:
                break
            self._place(b, keys, taken)
        # single keys take the free slots directly: their displacement is the slot, marked by the top bit
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        self.shift[single] = free.astype(np.uint32) | np.uint32(1 << 31)
        self.slots = np.empty((self.n, 32), np.uint8)
        self.origin = np.empty(self.n, np.int64)
        at = self.slot(digests)
        self.slots[at], self.origin[at] = digests, np.arange(self.n)

    def _place(self, b: int, keys: np.ndarray, taken: np.ndarray) -> None:
        for first in range(0, 1 << 30, 64):
            tries = np.arange(first, first + 64, dtype=np.uint64)
            at = (_mix(keys[:, 2][None, :] + tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
            at.sort(axis=1)
            good = ~taken[at].any(axis=1) & (np.diff(at, axis=1) != 0).all(axis=1)
            if good.any():
                k = int(good.argmax())
                taken[at[k]] = True
                self.shift[b] = first + k
                return
        raise ValueError("no displacement")

    def slot(self, digests: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)
        shift = self.shift[(words[:, 1] % np.uint64(self.buckets)).astype(np.int64)]
        direct = shift >> np.uint32(31) == 1
        tried = (_mix(words[:, 2] + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(direct, (shift & np.uint32((1 << 31) - 1)).astype(np.int64), tried)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """Index of the key each digest equals, byte for byte; -1 for nonmembers."""
        if not self.n or not len(digests):
            return np.full(len(digests), -1)
        at = self.slot(digests)
        return np.where((self.slots[at] == digests).all(axis=1), self.origin[at], -1)


def digests(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, digest binary) of the text, A-Z lower-cased."""
    renamed = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    start = lambda: lambda texts: [[hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()).digest() for t in texts]]
    return map_rows(renamed, ["doc_id"], "text", "digest binary", start)


def _summed(df: DataFrame, old: bool) -> DataFrame:
    return df.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).withColumn("old", F.lit(old))


def merge_groups(history: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of history (digest, keep_id, n) and fresh, each with distinct digests."""
    both = history.unionByName(fresh).withColumn("shard", F.pmod(F.crc32("digest"), F.lit(shards)).cast("int"))
    out = both.select("digest", "keep_id", F.col("n").alias("group_size")).schema
    arrow = arrow_schema(out)

    def run(t: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        old = np.asarray(t.column("old").to_pylist(), bool)
        ids, counts = t.column("keep_id").to_pylist(), t.column("n").to_pylist()
        was, now = np.flatnonzero(old), np.flatnonzero(~old)
        found = PerfectHash(raw[was]).lookup(raw[now])
        for i, k in zip(now.tolist(), found.tolist(), strict=True):
            if k >= 0:
                j = int(was[k])
                ids[j] = max((x for x in (ids[i], ids[j]) if x is not None), default=None)
                counts[j] += counts[i]
        rows = [*was.tolist(), *now[found < 0].tolist()]
        return pa.Table.from_arrays([pa.array([raw[i].tobytes() for i in rows], pa.binary()), pa.array([ids[i] for i in rows], arrow.field(1).type), pa.array([counts[i] for i in rows], pa.int64())], schema=arrow)

    return both.groupBy("shard").applyInArrow(run, out)


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", old: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size long, kept boolean, text_sha256 string), one row for each row.

    History is what the perfect hash is made of: the rows for which old (a condition on doc_id) holds, and
    known, a table (digest binary, keep_id, n) of digests that aren't in df; without either all rows group by
    themselves. Rows of known count for group sizes and may be what stays, and give no rows of their own.
    """
    rows = written(digests(df, text_col, id_col))
    old = F.lit(False) if old is None else F.coalesce(old, F.lit(False))
    history, fresh = _summed(rows.filter(old), True), _summed(rows.filter(~old), False)
    if known is not None:
        both = history.select("digest", "keep_id", "n").unionByName(known.select("digest", "keep_id", F.col("n").cast("long").alias("n")))
        history = both.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).withColumn("old", F.lit(True))
    shards = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(rows.count() + (known.count() if known is not None else 0)) // SHARD_KEYS))
    groups = written(merge_groups(history, fresh, shards), narrow=True)
    joined = rows.join(groups, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def even_half(id_col: str = "doc_id") -> Column:
    """Half of the ids, by a hash: the history that the query takes."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
