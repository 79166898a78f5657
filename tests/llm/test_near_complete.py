"""The near-dedup stage against brute force over all pairs, however far apart their fingerprints are."""

import random

from quillwork.llm import simhash


def jaccard(a, b):
    a, b = (set(simhash.features(x or "", 5, True)) or {b""} for x in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_finds_pairs_of_distant_fingerprints(spark):
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("bcdfglmnprst") + pick.choice("aeiou") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(40):
        words = [word() for _ in range(50 + 5 * g)]
        rows.append((g * 10, " ".join(words)))
        at = len(words) // 2
        for i in range(1, 5):  # new words in one place change few shingles and many bits
            rows.append((g * 10 + i, " ".join(words[:at] + [word() for _ in range(len(words) * i // 20)] + words[at:])))
        rows.append((g * 10 + 5, " ".join(words + passage)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "two one"), (1004, "ONE  two")]
    texts = dict(rows)
    prints = {i: simhash.fingerprint(t or "", 1, True) for i, t in rows}
    distant = [(i, j) for i in texts for j in texts if i < j and (prints[i] ^ prints[j]).bit_count() > 5 and jaccard(texts[i], texts[j]) >= 0.8]
    assert len(distant) > 20
    stay = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, t in rows:
        if i not in stay:
            assert max(jaccard(t, texts[j]) for j in stay) >= 0.8
    assert [(i, j) for i in stay for j in stay if i < j and jaccard(texts[i], texts[j]) >= 0.8] == []
