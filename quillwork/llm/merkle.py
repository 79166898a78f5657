"""Merkle manifest of a data set: a tree of digests by group, and a proof of each row.

A row's leaf digests its fields. Within a group (a language) leaves ascend by id; every ARITY consecutive
nodes become the digest of theirs until one node is left, the group's subroot; subroots, ordered by group,
become the root in the same way.

Leaves are numbered within their group without ever bringing a group together: a range sort of digests, row
counts by (partition, group), and sums of those before. BLOCK consecutive leaves, aligned so that they are a
whole subtree, go to one task, which climbs them by postorder recursion: the digest of a subtree is returned,
and siblings are appended to all contained leaves while the recursion unwinds. Roots of blocks are the leaves
of another such traversal, and so on, until each group has one block; the path of a block reaches its leaves
in the last traversal, as the row in front of them. Texts are read once; all that is shuffled is digests.

A null field is written as "-". A null group is a group of its own, before all others. Null or repeated ids
keep a row each: null ids come first, and rows of one id are ordered by their leaf (wholly alike rows are the
same leaf, whichever comes first). A null id counts as the empty text where it is hashed. An empty table gives
no row. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, discard, small_batches, written

ARITY, LEVELS = 8, 3
#: Nodes of one traversal: an aligned subtree of LEVELS levels.
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<place:int,others:array<string>>>"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it is digested: its UTF-8 byte count, a colon and its text, or "-" for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def third_of(id_col: Column) -> Column:
    """Whether 3 divides the unsigned crc32 of the id as text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 0


def climb(digests: list[str], height: int) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """Root of a subtree of this height over at most ARITY**height nodes, and of each node its path: by level,
    upwards, its place among the children and all of those children's digests."""
    paths: list[list[tuple[int, list[str]]]] = [[] for _ in digests]

    def visit(lo: int, hi: int, level: int) -> str:
        if level == 0:
            return digests[lo]
        step = ARITY ** (level - 1)
        parts = range(lo, hi, step)
        children = [visit(at, min(at + step, hi), level - 1) for at in parts]
        for k, at in enumerate(parts):
            for path in paths[at : min(at + step, hi)]:
                path.append((k, children))
        return _h(*children)

    return visit(0, len(digests), height), paths


def height_of(total: int) -> int:
    """Levels that a block of a tree of this many nodes has: all LEVELS, or as many as leave one node."""
    height = 0
    while height < LEVELS and ARITY**height < total:
        height += 1
    return height


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and the others of each level give."""
    for place, others in path:
        leaf = _h(*others[:place], leaf, *others[place:])
    return leaf


def _apart(path: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    return [(k, children[:k] + children[k + 1 :]) for k, children in path]


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with (place, total): a row's number from 0 within its group by order, and the group's rows."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    held = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    each = Window.partitionBy(group)
    counts = held.groupBy(group, "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(each.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(each))
    same = F.col(f"r.{group}").eqNullSafe(F.col(f"c.{group}")) & (F.col("r.part") == F.col("c.part"))
    return held.alias("r").join(counts.alias("c"), same).select("r.*", (F.col("seq") - F.col("first") + F.col("before")).alias("place"), "total").drop("part", "seq")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each run of equal first two columns, whatever batches they came in."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != key:
                yield held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield held


def _by_block(nodes: DataFrame, group: str) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}")).repartition(group, "block").sortWithinPartitions(group, "block", "place")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    part = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        part.append(row)
        if len(part) == size:
            yield made()
            part = []
    if part:
        yield made()


def block_roots(nodes: DataFrame, group: str) -> DataFrame:
    """(group, place, digest, total) of blocks of nodes (group, place, digest, total): one level of blocks up."""
    given = _by_block(nodes, group).select(group, "block", "digest", "total")
    out = given.select(group, F.col("block").alias("place"), "digest", "total").schema
    arrow = arrow_schema(out)

    def run(batches):
        rows = ((b[0][0], b[0][1], bytes.fromhex(climb([r[2].hex() for r in b], height_of(b[0][3]))[0]), -(-b[0][3] // BLOCK)) for b in _blocks(batches))
        yield from _batches(rows, arrow)

    return given.mapInArrow(run, out)


def paths_in_blocks(nodes: DataFrame, group: str) -> DataFrame:
    """(group, block, place, total, digest, path) of nodes: digest is that of the block's root."""
    given = _by_block(nodes, group).select(group, "block", "place", "total", "digest")
    out = given.withColumn("path", F.lit(None).cast(_PATH)).schema
    arrow = arrow_schema(out)

    def run(batches):
        def rows():
            for b in _blocks(batches):
                top, paths = climb([r[4].hex() for r in b], height_of(b[0][3]))
                for row, path in zip(b, paths, strict=True):
                    yield (*row[:4], bytes.fromhex(top), [{"place": k, "others": o} for k, o in _apart(path)])

        yield from _batches(rows(), arrow)

    return given.mapInArrow(run, out)


def tree(nodes: DataFrame, group: str, beyond: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(group, place, subroot, root, path to the root) of all nodes (group, place, digest, total).

    beyond: of (group, digest), one row a group, makes (group, subroot, root, path); it is joined where each
    group has one block, so that no group brings more than BLOCK rows to a task.
    """
    part = written(paths_in_blocks(nodes, group))
    if part.filter(F.col("total") > BLOCK).isEmpty():
        above = beyond(part.filter("place = 0").select(group, "digest")).withColumn("block", F.lit(0).cast("long"))
    else:
        tops = part.filter(f"place % {BLOCK} = 0").select(group, F.col("block").alias("place"), "digest", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"))
        above = tree(tops, group, beyond).withColumnRenamed("place", "block")
    same = F.col(f"p.{group}").eqNullSafe(F.col(f"a.{group}")) & (F.col("p.block") == F.col("a.block"))
    joined = part.alias("p").join(above.alias("a"), same)
    return joined.select(f"p.{group}", "p.place", "a.subroot", "a.root", F.concat("p.path", "a.path").alias("path"))


def _groups_above(tops: DataFrame) -> DataFrame:
    """(grp, subroot, root, path): the tree over subroots, ordered by group."""
    ordered = written(numbered(tops.withColumn("all", F.lit(0)), "all", ["grp"]))

    def at_root(top: DataFrame) -> DataFrame:
        return top.select("all", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"), F.lit([]).cast(_PATH).alias("path"))

    found = tree(ordered.select("all", "place", "digest", "total"), "all", at_root)
    return ordered.alias("o").join(found.alias("f"), "place").select("o.grp", F.lower(F.hex("o.digest")).alias("subroot"), "f.root", "f.path")


def manifest(df: DataFrame, fields: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", with_proof: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root: string; verified boolean[, proof:
    array<struct<place int, others array<string>>>]), a row a row.

    fields: columns a leaf digests, in order (id, source, group, n_chars and text if None). proof: of each level
    up to the root the row's place among siblings and the others' digests. folded_root is what the proof gives
    for the row as it would be if A-Z in the texts of a third of all rows (third_of) had been lower-cased.
    """
    small_batches(df.sparkSession)
    fields = fields or [id_col, "source", group_col, "n_chars", text_col]
    given = df.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("grp"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    values = [F.col(f"f{i}") for i in range(len(fields))]
    tampered = [lower_ascii(v.cast("string")) if c == text_col else v for v, c in zip(values, fields, strict=True)]
    leaves = written(given.select("doc_id", "grp", digest(values).alias("digest"), F.when(third_of(F.col("doc_id")), digest(tampered)).alias("now"), F.monotonically_increasing_id().alias("row")))
    placed = written(numbered(leaves, "grp", ["doc_id", "digest", "row"]).drop("row"))
    discard(leaves)
    blocks = written(block_roots(placed, "grp"))
    above = tree(blocks, "grp", _groups_above)

    front = above.select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast(placed.schema["doc_id"].dataType).alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("digest", "binary"), ("now", "binary"), ("total", "long"))], "subroot", "root", "path")
    rows = placed.withColumn("block", F.expr(f"place div {BLOCK}")).withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "path": F.lit(None).cast(_PATH)})
    both = front.unionByName(rows.select(*front.columns)).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
    out = both.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"), "path").withColumnRenamed("path", "proof").schema
    arrow = arrow_schema(out)

    def run(batches):
        def results():
            for (*_, subroot, root, upper), *held in _blocks(batches):
                beyond = [(s["place"], s["others"]) for s in upper]
                _, paths = climb([r[4].hex() for r in held], height_of(held[0][6]))
                for row, inner in zip(held, paths, strict=True):
                    path = _apart(inner) + beyond
                    proof = hashlib.sha256()
                    for _, others in path:
                        proof.update("".join(others).encode())
                    leaf = row[4].hex()
                    folded = fold(row[5].hex() if row[5] else leaf, path)
                    yield row[3], leaf, subroot, root, proof.hexdigest(), folded, folded == root, [{"place": k, "others": o} for k, o in path] if with_proof else None

        yield from _batches(results(), arrow)

    made = both.mapInArrow(run, out)
    return made if with_proof else made.drop("proof")
