"""The near-dedup stage: who goes resembles one that stays, and who stays resembles no one of the component."""

import random

from quillwork.llm import simhash


def jaccard(a, b):
    a, b = (set(simhash.features(x or "", 5, True)) or {b""} for x in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_verifies_similarity(spark):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("bcdfglmnprst") + pick.choice("aeiou") for _ in range(3))
    rows = []
    for g in range(12):
        words = [word() for _ in range(120)]
        rows.append((g * 100, " ".join(words)))
        for i in range(1, 8):  # from one changed word to about a dozen: some lie above 0.8, some below
            other = list(words)
            for at in range(0, 120, 120 // (2 * i)):
                other[at] = other[at] if pick.random() < 0.3 else word()
            rows.append((g * 100 + i, " ".join(other)))
        rows.append((g * 100 + 50, " ".join(sorted(words))))  # the same set of words, other shingles
        rows.append((g * 100 + 60, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, "lonely"), (None, "lonely"), (5003, "one two"), (5003, "one two")]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, same long").repartition(5)
    one = simhash.keep_one(df)
    assert one.columns == df.columns
    stay = [(r.doc_id, r.text) for r in one.collect()]
    ids = [i for i, _ in stay]
    assert len(ids) == len(set(ids)) and {None, 5000, 5003} <= set(ids) and not {5001, 5002} & set(ids)
    assert all(g * 100 in ids and g * 100 + 50 in ids and g * 100 + 60 not in ids for g in range(12))
    prints = {i: simhash.fingerprint(t or "", 1, True) for i, t in rows}
    texts = dict(rows)
    for i, t in rows:
        if i not in ids:
            assert max(jaccard(t, s) for _, s in stay) >= 0.8
    near = 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if a is not None and b is not None and (prints[a] ^ prints[b]).bit_count() <= 5:
                near += 1
                assert jaccard(texts[a], texts[b]) < 0.8
    assert near >= 12


def test_keep_one_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.keep_one(df).collect() == []
