"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints within the distance, at
least one segment differs by one bit at most: (distance + 1) / 2 segments, rounded up. Each segment
is indexed once for each of its bits with that bit deleted; fingerprints that share a variant meet in
a bucket and are verified by their distance. Two segments of 32 bits serve a distance of 2 or 3.

Rows are reduced to distinct fingerprints before the index is made. A bucket is read as a sorted run
within a task and yields links that span its connected members (at most one fewer than its
members), found by breadth-first search over vectorised distances, so no group is expanded into all
pairs and no link between components is lost. Large buckets are first split by further segments.

A null text is the empty text; texts without words have fingerprint zero and are linked like any
other. Null ids come last: a component of null ids only has a null component id. Repeated ids keep
a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import count
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_schema, discard, map_rows, text_of, written
from .components import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Verification of near duplicates: words of a shingle, least similarity, leaders of a component a round, rounds.
VERIFIED_SHINGLE, SIMILARITY, LEADERS, ROUNDS = 5, 0.8, 16, 3
#: Standard deviations within which signatures leave a pair to be verified: of all texts, and with a leader.
SURE, LIKELY = 7.0, 3.0
#: Words of 64 bins that a signature has.
WORDS = 8
#: Rounds in which similar texts are taken by rank; rows of a table that may be broadcast.
PLAIN, FEW = 12, 2**18
#: A shingle is common from so many texts of the sample on; so many at most are kept apart.
COMMON, MOST_COMMON = 8, 2**17
#: Buckets of more distinct fingerprints are split by further segments before they are searched.
LARGE = 2_048
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def features(text: str, shingle: int, distinct: bool = False) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    if shingle == 1:
        found = words
    elif shingle == 3:
        found = [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    else:
        found = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    return list(dict.fromkeys(found)) if distinct else found


def fingerprint(text: str, shingle: int = SHINGLE, distinct: bool = False) -> int:
    """Bit set: set in over half of the features' hashes."""
    found = features(text, shingle, distinct)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in found), np.uint64, len(found))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    count = max(1, (distance + 2) // 2)
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(prints: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """For each segment and bit: keys that name both, and the segment's value with the bit deleted."""
    for s, (low, width) in enumerate(segments(distance)):
        value = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for p in range(width):
            rest = ((value >> np.uint64(p + 1)) << np.uint64(p)) | (value & np.uint64((1 << p) - 1))
            tag = s * 64 + p
            yield rest | (np.uint64(tag) << np.uint64(52)) if width <= 52 else rest ^ np.uint64(tag << 55)


def spanning(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected by links of that distance among distinct fingerprints."""
    if len(prints) > LARGE:
        pairs = []
        edges = [64 * i // (distance + 1) for i in range(distance + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(part, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(group) > 1:
                    pairs += _search(prints[group], distance)
        return pairs
    return _search(prints, distance)


def _search(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    pairs, left = [], prints
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                pairs += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return pairs


def links(prints: DataFrame, distance: int) -> DataFrame:
    """(a long, b long) that span the components among distinct fingerprints (fp long)."""

    def index(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for keys in variants(values, distance):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values.view(np.int64))], names=["key", "fp"])

    def join(batches):
        held_key, held = None, []

        def close():
            members = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
            return spanning(members, distance) if len(members) > 1 else []

        for batch in batches:
            pairs = []
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            first = int(cuts[0]) if len(cuts) else len(keys)
            if held_key is not None and keys[0] != held_key:
                pairs += close()
                held = []
            held.append(values[:first].copy())
            held_key = keys[0]
            if len(cuts):
                pairs += close()
                starts = np.concatenate([cuts, [len(keys)]])
                sizes = np.diff(starts)
                for k in np.flatnonzero(sizes[:-1] > 1).tolist():
                    pairs += spanning(values[starts[k] : starts[k + 1]], distance)
                held, held_key = [values[starts[-2] :].copy()], keys[-1]
            if pairs:
                yield _links(pairs)
        if held:
            pairs = close()
            if pairs:
                yield _links(pairs)

    keys = prints.select("fp").mapInArrow(index, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long").distinct()


def _links(pairs):
    both = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def fingerprints(df: DataFrame, text_col: str, id_col: str, shingle: int, distinct: bool) -> DataFrame:
    """(doc_id, fp long)"""
    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    start = lambda: lambda texts: [np.array([fingerprint(t, shingle, distinct) for t in texts], np.uint64).view(np.int64)]
    return map_rows(given, ["doc_id"], "text", "fp long", start)


def _named(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, least, root) for the distinct fingerprints of rows (doc_id, fp): least id, and component."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), narrow=True)
    roots = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    out = written(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), narrow=True)
    discard(nodes)
    return out


def classes(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of rows (doc_id, fp)."""
    named = _named(rows, distance)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, distinct: bool = False) -> DataFrame:
    """(doc_id, fingerprint string of 16 hex digits, component_id), one row a row."""
    rows = written(fingerprints(df, text_col, id_col, shingle, distinct))
    return rows.join(classes(rows, distance), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str) -> np.ndarray:
    """Hashes of the set of five-word shingles, in order. Texts without words are alike."""
    digest = xxhash.xxh64_intdigest
    found = features(text, VERIFIED_SHINGLE, True) or [b""]
    return np.unique(np.fromiter((digest(x, SEED) for x in found), np.uint64, len(found)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a set of shingles as 2 * WORDS numbers (long): the lowest bit of each bin's least
    hash, then which bins aren't empty."""
    least = np.full(64 * WORDS, np.uint64(2**64 - 1))
    held = np.zeros(64 * WORDS, bool)
    place = ((hashes >> np.uint64(32)) * np.uint64(64 * WORDS) >> np.uint64(32)).astype(np.intp)
    np.minimum.at(least, place, hashes)
    held[place] = True
    words = np.concatenate([np.packbits((least & np.uint64(1)).astype(bool) & held), np.packbits(held)])
    return words.view(">u8").astype(np.uint64).view(np.int64)


def most_unlike(bins: int, deviations: float) -> float:
    """Of bins that two sets both fill, the bits that differ at most if their similarity is SIMILARITY or more,
    but for chances beyond so many standard deviations."""
    share = (1 - SIMILARITY) / 2
    return share * bins + deviations * (share * (1 - share) * bins) ** 0.5


def unlike(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Of two signatures: bins that one of them fills, both fill, and of these those whose bits differ."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    count = lambda x: int(np.bitwise_count(x).sum())
    both = a[WORDS:] & b[WORDS:]
    return count(a[WORDS:] ^ b[WORDS:]), count(both), count((a[:WORDS] ^ b[:WORDS]) & both)


def may_be_alike(deviations: float) -> Column:
    """Whether signatures (mark_a, size_a) and (mark_b, size_b) leave a similarity of SIMILARITY possible. Every bin
    in which they differ holds a shingle that only one set has, and similar sets have a ninth of their shingles'
    number of those at most; for sets that fill all bins the bits alone tell."""
    word = lambda side, i: F.get(F.col(f"mark_{side}"), F.lit(i))
    both = [word("a", WORDS + i).bitwiseAND(word("b", WORDS + i)) for i in range(WORDS)]
    total = lambda columns: reduce(add, map(F.bit_count, columns))
    one = total(word("a", WORDS + i).bitwiseXOR(word("b", WORDS + i)) for i in range(WORDS))
    bits = total(word("a", i).bitwiseXOR(word("b", i)).bitwiseAND(b) for i, b in enumerate(both))
    share, n = (1 - SIMILARITY) / 2, total(both)
    return (9 * (one + bits) <= F.col("size_a") + F.col("size_b")) & (bits <= share * n + deviations * F.sqrt(share * (1 - share) * n))


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in an order that puts the common ones last: sets with a Jaccard similarity of
    SIMILARITY or more share one of them at least, whatever the order."""
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = common[at] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    return hashes[: len(hashes) - -(-4 * len(hashes) // 5) + 1]


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles (in order) that several of a sixteenth of the texts hold. They only order prefixes, so that
    few texts meet in one; which pairs are found doesn't depend on them."""

    def counted(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            if found:
                names, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).mapInArrow(counted, "h long, n long")
    often = some.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n")).limit(MOST_COMMON)
    return np.sort(often.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def candidates(sets: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(a long, b long): all pairs of sets (t long, size long, prefix binary, mark array<long>) that can reach
    SIMILARITY, and some that can't, by a shingle that both prefixes hold, their sizes, its places in the
    sets, and their signatures. only: shingles to meet in, sorted; all if None."""

    def index(batches):
        for batch in batches:
            t, size, held = (batch.column(i) for i in range(3))
            keys = [np.frombuffer(x, np.int64) for x in held.to_pylist()]
            counts = np.array([len(k) for k in keys], np.int64)
            if not len(keys):
                continue
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [np.concatenate(keys), np.repeat(t.to_numpy(), counts), np.repeat(size.to_numpy(), counts), at]
            if only is not None:
                wanted = np.isin(columns[0], only)
                columns = [c[wanted] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "t", "size", "at"])

    def found(key, t, size, at):
        i, step = np.arange(len(key)), 1
        while len(i):
            i = i[i + step < len(key)]
            j = i + step
            within = (key[i] == key[j]) & (5 * size[i] >= 4 * size[j])
            i, j = i[within], j[within]
            bound = np.minimum(at[i], at[j]) + np.minimum(size[i] - at[i], size[j] - at[j])
            hit = (9 * bound >= 4 * (size[i] + size[j])) & (t[i] != t[j])
            if hit.any():
                x, y = t[i[hit]], t[j[hit]]
                yield np.stack([np.minimum(x, y), np.maximum(x, y)], 1)
            step += 1

    def join(batches):
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [r[cut:] for r in rows]
            for pairs in found(*[r[:cut] for r in rows]):
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        for pairs in found(*held):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    entries = sets.select("t", "size", "prefix").mapInArrow(index, "key long, t long, size long, at long")
    pairs = entries.repartition("key").sortWithinPartitions("key", "size").mapInArrow(join, "a long, b long").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("t").alias(c), F.col("mark").alias(f"mark_{c}"), F.col("size").alias(f"size_{c}")), c)
    return pairs.filter(may_be_alike(SURE)).select("a", "b")


def few(df: DataFrame, rows: int = FEW) -> bool:
    """Whether a table of narrow rows is small enough to be broadcast: it has at most so many."""
    return df.count() <= rows


def narrowed(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key is among ids (a written table): without a shuffle of df as
    long as the ids are few, else by one."""
    return df.join(F.broadcast(ids.select(*on)) if few(ids) else ids.select(*on), on, "left_semi")


def sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(t, held binary): the sets of five-word shingles of those texts (t, text) whose t is among ids (a written table)."""
    found = map_rows(narrowed(texts, ids, ["t"]), ["t"], "text", "held binary", lambda: lambda found: [[shingles(x).tobytes() for x in found]])
    return written(found.groupBy("t").agg(F.first("held").alias("held")))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a long, b long) whose sets (t, held) have a Jaccard similarity of SIMILARITY or more."""

    def judge(batches):
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            good = []
            for x, y in zip(one, two, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(9 * both >= 4 * (len(x) + len(y)))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    of = lambda c: sets.select(F.col("t").alias(c), F.col("held").alias(f"held_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "held_a", "held_b").mapInArrow(judge, "a long, b long")


def _yield(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(t) of the ends of similar pairs (a, b; a written table) that go: taken by rank (t, rank), a text stays
    unless it resembles one that stays. Each round settles all texts that no open one precedes. Long chains
    of texts, each like the next, would take a round for every other one: what PLAIN rounds leave open is
    taken in the order of a hash, by which rounds are about as many as the logarithm of what is left."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = both.join(ranks.select(F.col("t").alias("a"), F.col("rank").alias("ra")), "a").join(ranks.select(F.col("t").alias("b"), F.col("rank").alias("rb")), "b")
    left = written(ranked.select("a", "b", (F.col("rb") < F.col("ra")).alias("before")), narrow=True)
    hashed = (F.struct(F.xxhash64("b"), "b") < F.struct(F.xxhash64("a"), "a")).alias("before")
    gone = pairs.select(F.col("a").alias("t")).limit(0)
    for done in count(1):
        if left.isEmpty():
            return gone
        stay = written(left.groupBy("a").agg(F.max("before").alias("before")).filter("not before").select("a"), narrow=True)
        out = written(left.join(stay, "a", "left_semi").select(F.col("b").alias("t")).distinct(), narrow=True)
        gone = gone.unionByName(out)
        settled = out.unionByName(stay.withColumnRenamed("a", "t"))
        open_pairs = left.join(settled.withColumnRenamed("t", "a"), "a", "left_anti").join(settled.withColumnRenamed("t", "b"), "b", "left_anti")
        after = written(open_pairs.select("a", "b", hashed if done == PLAIN else "before"), narrow=True)
        discard(left, stay)
        left = after


def _led(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a leader that stays, b that goes for it: t of each) of the distinct texts (root, t, none, id, order, mark,
    size) of components; sets: (t, held).

    In each of ROUNDS rounds the first text of each of LEADERS hash classes of a component leads. Leaders and
    texts whose signatures leave it possible are compared by their sets of shingles. Leaders are taken in order
    and stay unless they resemble one that stays; all others go for the first that stays and that they
    resemble, or else wait for the next round. A text meets LEADERS others a round at most, however large its
    group, and joins on components can be split. Texts that wait in the end are compared like all others.
    """
    first = F.struct("none", "id", "order", "t", "mark", "size")
    left, found = texts, texts.select(F.col("t").alias("a"), F.col("t").alias("b")).limit(0)
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)

    def taken(mask: Column, i: Column) -> Column:
        """The leaders that stay, given those before and that leader i resembles (near[i]) some of them."""
        return F.when(F.get("near", i).bitwiseAND(mask) == 0, mask.bitwiseOR(bit(i))).otherwise(mask)

    for _ in range(ROUNDS):
        classes = left.groupBy("root", F.pmod(F.xxhash64("t"), F.lit(LEADERS)).alias("class")).agg(F.min(first).alias("f"))
        led = classes.groupBy("root").agg(F.array_sort(F.collect_list("f")).alias("f"))
        led = written(led.select("root", F.transform("f", lambda x: F.struct(x["t"].alias("t"), x["mark"].alias("mark_a"), x["size"].alias("size_a"))).alias("leads")), narrow=True)
        met = left.join(led, "root").select("root", "t", F.col("mark").alias("mark_b"), F.col("size").alias("size_b"), F.array_position(F.transform("leads", lambda x: x["t"]), F.col("t")).alias("place"), F.posexplode("leads").alias("i", "l"))
        # place: of a leader among the leaders, from 1; it meets those before it
        met = met.filter((F.col("place") == 0) | (F.col("i") < F.col("place") - 1)).select("root", "t", "i", "mark_b", "size_b", "l.mark_a", "l.size_a", F.col("l.t").alias("a"))
        met = written(met.filter(may_be_alike(LIKELY)).select("root", "i", "a", F.col("t").alias("b")), narrow=True)
        alike = similar(met.select("a", "b"), sets).distinct().join(met, ["a", "b"])
        near = written(alike.groupBy("root", "b").agg(F.bit_or(bit(F.col("i"))).alias("near")), narrow=True)
        each = led.select("root", F.posexplode("leads").alias("i", "l")).select("root", "i", F.col("l.t").alias("b")).join(near, ["root", "b"], "left")
        rows = each.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("i", "b", F.coalesce("near", F.lit(0)).alias("near")))).alias("r"))
        rows = rows.select("root", F.transform("r", lambda x: x["b"]).alias("names"), F.transform("r", lambda x: x["near"]).alias("near"))
        stay = rows.select("root", "names", F.aggregate(F.sequence(F.lit(0), F.size("near") - 1), F.lit(0), taken).alias("mask"))
        both = near.join(stay, "root").select("b", "names", F.col("near").bitwiseAND(F.col("mask")).alias("hit")).filter("hit <> 0")
        lowest = F.array_position(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.col("hit").bitwiseAND(bit(i)) != 0), F.lit(True)).cast("int")
        gone = written(both.select(F.element_at("names", lowest).alias("a"), "b"), narrow=True)
        leaders = led.select(F.explode("leads").alias("l")).select(F.col("l.t").alias("t"))
        found = found.unionByName(gone)
        after = written(left.join(gone.select(F.col("b").alias("t")).unionByName(leaders).distinct(), "t", "left_anti").select(*texts.columns), narrow=True)
        discard(led, met, near)
        left = after
        if left.isEmpty():
            break
    return found


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 1, distance: int = 5, distinct: bool = True) -> DataFrame:
    """One row of each group of near duplicates, columns unchanged: each text that goes has a Jaccard
    similarity of its five-word shingles of 0.8 or more to one that stays, and no two that stay have.

    Copies and most near copies meet as components of fingerprints of the set of words at a distance of
    5 and go for leaders, by the similarity of their shingles, which needs no pairs within a group. All texts that are left, whatever their fingerprints, are
    compared by the shingles in the prefixes of their sets, which miss no pair, but for pairs whose signatures
    differ by what a similarity of 0.8 brings about once in 10**8 times at most; of similar ones those that more texts have gone for stay, then those of least id. Texts whose leader goes so are compared anew
    with all that stay.

    Of equal texts (null is empty) the row of least id stays, null ids last, ties by a hash of the row.
    Only what is made from texts is written, and df is read again for the texts that pairs need and for the
    rows that stay: df should give the same rows each time, as a table does.
    """
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    common = common_shingles(renamed.select(text_of(text).alias("text")))
    same, order = F.unhex(F.md5(text_of(text).cast("binary"))).alias("same"), F.xxhash64(*renamed.columns).alias("order")

    def start():
        def make(found):
            sets = [shingles(t) for t in found]
            prints = np.array([fingerprint(t, shingle, distinct) for t in found], np.uint64).view(np.int64)
            return [prints, [signature(x) for x in sets], [len(x) for x in sets], [prefix(x, common).tobytes() for x in sets]]

        return make

    given = renamed.select(F.col(key).alias("id"), same, order, F.col(text).alias("text"))
    rows = written(map_rows(given, ["id", "same", "order"], "text", "fp long, mark array<long>, size long, prefix binary", start))
    named = _named(rows.select(F.col("id").alias("doc_id"), "fp"), distance)
    texts = rows.groupBy("fp", "same").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "order", "mark", "size")).alias("w"))
    texts = written(texts.join(named.select("fp", "root"), "fp").select("root", "same", "w.*"), narrow=True)
    discard(named)
    several = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    t = F.xxhash64("same").alias("t")
    held = renamed.select(same, text_of(text).alias("text")).select(t, "text")
    sets = rows.select(t, "size", "prefix", "mark")
    many = written(texts.join(several, "root", "left_semi").select("root", t, "none", "id", "order", "mark", "size"), narrow=True)
    sets_met = sets_of(held, many)
    led = written(_led(many, sets_met), narrow=True)  # (a leader, b that goes for it)
    discard(sets_met)
    ranks = texts.select(t, "none", "id", "order").join(led.groupBy(F.col("a").alias("t")).agg(F.count(F.lit(1)).alias("n")), "t", "left")
    ranks = written(ranks.select("t", F.struct(-F.coalesce("n", F.lit(0)), "none", "id", "order").alias("rank")), narrow=True)

    def once(among: DataFrame) -> DataFrame:
        # copies are summed up before the shuffle, so that none of them meet in one task
        found = sets.groupBy("t").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "mark")])
        return found.join(among, "t", "left_semi")

    def met(among: DataFrame, only: np.ndarray | None = None) -> DataFrame:
        given = written(once(among))
        pairs = written(candidates(given, only), narrow=True)
        discard(given)
        named = written(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct(), narrow=True)
        found = sets_of(held, named)
        out = written(similar(pairs, found), narrow=True)
        discard(pairs, named, found)
        return out

    left = ranks.select("t").join(led.select(F.col("b").alias("t")), "t", "left_anti")
    gone = written(_yield(met(left), ranks), narrow=True)
    lost = written(led.join(gone.select(F.col("t").alias("a")), "a", "left_semi").select(F.col("b").alias("t")), narrow=True)
    out = led.select(F.col("b").alias("t")).join(lost, "t", "left_anti").unionByName(gone)
    if not lost.isEmpty():
        stay = left.join(gone, "t", "left_anti")
        late = ranks.join(lost.withColumn("late", F.lit(1)), "t", "left").select("t", F.struct(F.coalesce("late", F.lit(0)).alias("late"), "rank").alias("rank"))
        mine = written(once(lost).select(F.explode(F.expr("transform(sequence(0, length(prefix) div 8 - 1), i -> substring(prefix, i * 8 + 1, 8))")).alias("key")).distinct())
        only = np.sort(np.frombuffer(b"".join(bytes(r["key"]) for r in mine.collect()), np.int64)) if few(mine) else None
        out = out.unionByName(_yield(met(stay.unionByName(lost), only), late))
    gone = written(out.distinct(), narrow=True)
    winners = written(texts.select("same", "order", t).join(gone, "t", "left_anti").select("same", "order"), narrow=True)
    # rows that are wholly alike share their order: only of them one is picked by an aggregation
    twins = written(rows.join(winners, ["same", "order"], "left_semi").groupBy("same", "order").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "order"), narrow=True)
    alone = written(winners.join(twins, ["same", "order"], "left_anti"), narrow=True)
    marked = renamed.select("*", same, order)
    single = narrowed(marked, alone, ["same", "order"]).select(*renamed.columns)
    picked = narrowed(marked, twins, ["same", "order"]).groupBy("same", "order").agg(F.first(F.struct(*renamed.columns)).alias("r")).select("r.*")
    return single.unionByName(picked).toDF(*names)
