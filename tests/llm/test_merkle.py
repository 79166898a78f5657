"""Merkle manifests against a tree that is built level by level over the whole table."""

import hashlib
import zlib

import pytest

from quillwork.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, path int, grp string"
ASCII = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def proofs(digests):
    """Root and, of each digest, the siblings by level with its place, by plain loops."""
    level, where, found = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            found[i].append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        level = [h("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        where = [at // 8 for at in where]
    return level[0], found


def whole(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = [], []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees.append((members, *proofs([leaf_of(r, r[4]) for r in members])))
    root, tops = proofs([t[1] for t in trees])
    for (members, subroot, found), top in zip(trees, tops, strict=True):
        for row, path in zip(members, found, strict=True):
            path = path + top
            low = row[4].translate(ASCII) if row[4] and zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 3 == 0 else row[4]
            folded = leaf_of(row, low)
            for k, others in path:
                folded = h("".join([*others[:k], folded, *others[k:]]))
            out.append((row[0], leaf_of(row, row[4]), subroot, root, h("".join(x for _, o in path for x in o)), folded, folded == root))
    return sorted(out, key=str)


def awkward():
    rows = [(i, "s", "en", i, f"Text {i % 40}") for i in range(1300)]
    rows += [(5000 - i, None, "de", None, "ÄÖ A" * i) for i in range(66)]
    rows += [(None, "s", None, 1, "X"), (None, "s", None, 1, "X"), (None, None, None, None, None), (7, "s", "", 1, ""), (7, "s", "", 1, None), (8, "ß", "zh", 3, "long " * 30_000)]
    return rows + [rows[3]] * 20


@pytest.mark.parametrize("parts", [1, 7])
def test_manifest_against_whole_tree(spark, parts):
    rows = awkward()
    df = spark.createDataFrame([(*r, "l", 1, "g") for r in rows], SCHEMA).repartition(parts)
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == whole(rows)


def test_proofs_fold_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, f"t{i}") for i in range(100)]
    got = merkle.manifest(spark.createDataFrame([(*r, "l", 1, "g") for r in rows], SCHEMA), with_proof=True).collect()
    for r in got:
        assert merkle.fold(r.leaf, [(s.place, list(s.others)) for s in r.proof]) == r.root


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", "en", 4, "Text", "l", 1, "g")], SCHEMA)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")
    assert merkle.manifest(one.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512])
def test_climb(n):
    digests = [h(str(i)) for i in range(n)]
    root, paths = merkle.climb(digests, merkle.height_of(n))
    want, found = proofs(digests)
    assert root == want and [merkle._apart(p) for p in paths] == found
