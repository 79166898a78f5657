"""Operators on very long texts, repeated rows, ties and clashing columns, against brute force."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillwork.llm import common, exact_dedup, language_id, media, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, score double, c0 string, at int, digest string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, 0.5, "c", 1, "d") for i, t, lang in rows], SCHEMA).repartition(parts)


# --- language -----------------------------------------------------------------------------------


def grams(text):
    """Hashed n-grams one by one."""
    letters = lambda c: ord(c) > 127 or "a" <= c <= "z"
    chars = [c if letters(c) else " " for c in text.lower()]
    chars = [c for k, c in enumerate(chars) if k == 0 or letters(c) or letters(chars[k - 1])]
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(chars) - n + 1):
            key = 0
            for c in chars[k : k + n]:
                key = (key * 0x01000193 + ord(c)) % 2**32 * 0x9E3779B1 % 2**32
            out[(key ^ (n * 0x05EBCA6B)) % 2**32 >> 18] += 1
    return out


def test_gram_counts_against_one_by_one():
    for text in ("", "a", "Hello, World 42!  ok", "né à ü 日本", "  x", "İstanbul ß"):
        got = language_id.gram_counts(text)
        want = grams(text)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want), text


def test_language_of_awkward_rows(spark):
    en, de = "the cat and the dog are here and there ", "der hund und die katze sind hier und dort "
    made = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(120)]
    made += [(500, en * 20_000, None), (501, None, "en"), (502, "12 34 !?", "de"), (None, de, None), (None, de, None), (3, en, "en"), (3, en, "en"), (4, "", "de"), (504, en + de, None)]
    df = table(spark, made)
    model = language_id.train(df)
    got = language_id.identify(df, model)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(made)
    want = sorted((str(i), zlib.crc32(str("" if i is None else i).encode()) % 3 == 1, model.predict(t)[0], round(model.predict(t)[1], 9)) for i, t, _ in made)
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in got.collect()) == want
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by[500] == "en" and by[501] == by[502] == by[4] == "und" and by[None] == "de" and all(by[i] == lang for i, _, lang in made[:120] if i not in (3, 4))


def test_language_ties_go_to_the_first(spark):
    model = language_id.Model(["de", "en"], np.zeros((language_id.DIMENSIONS, 2)), np.ones(language_id.DIMENSIONS), 1.0)
    assert model.predict("abc") == ("de", 0.5)
    assert language_id.Model([], np.zeros((language_id.DIMENSIONS, 0)), np.ones(language_id.DIMENSIONS), 1.0).predict("abc") == ("und", 0.0)


def test_sample_is_bounded_whatever_repeats(spark):
    df = spark.range(40_000).select(F.lit(7).cast("long").alias("id"), F.lit("same").alias("text"))
    got = common.sampled(df, F.xxhash64("id", "text", F.monotonically_increasing_id()), ["id"], 500)
    assert got.count() == 500 and got.columns == ["id", "text"]
    assert common.sampled(df.limit(20), F.xxhash64("id"), ["id"], 500).count() == 20


# --- token counts -------------------------------------------------------------------------------


def test_token_counts_of_awkward_rows(spark):
    pick = random.Random(3)
    long = " ".join("".join(pick.choice("abcdeéß日") for _ in range(pick.randint(1, 9))) for _ in range(20_000))
    made = [(1, long, "x"), (2, "x" * 6_000, None), (3, None, None), (4, "", "a"), (None, "a b a", "a"), (1, long, "x"), (5, "\t\n  ", None), (6, "a b　c", None)]
    pieces = token_counts.zipf_pieces(common.tokenizer_path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(table(spark, made))
    brute = lambda t: sum(n * token_counts.brute_count(w, pieces) for w, n in Counter((t or "").split()).items()) if len(t or "") < 50_000 else None
    want = Counter()
    known = {}
    for i, t, _ in made:
        words = Counter((t or "").split())
        for w in words:
            if w not in known:
                known[w] = token_counts.brute_count(w, pieces) if len(w) < 100 else None
        if all(known[w] is not None for w in words):
            want[i, sum(words.values()), sum(n * known[w] for w, n in words.items())] += 1
    rows = Counter(tuple(r)[:3] for r in got.collect() if r.doc_id != 2)
    assert rows == want and brute("a b a") == next(n for (i, _, n) in want if i is None)
    whole = token_counts.TrieCounter(pieces)
    assert [r[2] for r in got.collect() if r.doc_id == 2] == [whole.insert("x" * 6_000)]


def test_trie_is_emptied_between_slices(monkeypatch):
    pieces = token_counts.zipf_pieces(common.tokenizer_path("piece_bpe_32k.model"))
    texts = [f"word{i} other{i % 7} {i}" for i in range(300)]
    want = token_counts.TrieCounter(pieces).counts(texts)
    monkeypatch.setattr(token_counts, "NODES", 50)
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 60)
    counter = token_counts.TrieCounter(pieces)
    assert counter.counts(texts) == want and len(counter.children) < 200


# --- exact dedup --------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256((text or "").encode("utf-8").lower()).digest()


@pytest.mark.parametrize("old", [None, "even", "all"])
def test_exact_dedup_with_history(spark, old):
    pick = random.Random(8)
    made = [(i % 70, pick.choice(["Hot", "hot", "HOT É", "hot é", "", None, f"t{i % 9}"]), "x") for i in range(150)] + [(None, "hot", None), (None, "alone", None), (900, "z" * 300_000, None)]
    condition = {None: None, "even": exact_dedup.even_half(), "all": F.lit(True)}[old]
    known = [(digest("hot"), 5_000, 3), (digest("t1"), 1, 2), (digest("unseen"), 4, 9)]
    groups = {}
    for d, keep, n in known:
        groups[d] = [[keep], n]
    for i, t, _ in made:
        g = groups.setdefault(digest(t), [[], 0])
        g[0] += [i] if i is not None else []
        g[1] += 1
    want = sorted(str((i, max(groups[digest(t)][0], default=None), groups[digest(t)][1], i is not None and i == max(groups[digest(t)][0]), digest(t).hex())) for i, t, _ in made)
    got = exact_dedup.exact_dedup(table(spark, made), old=condition, known=spark.createDataFrame(known, "digest binary, keep_id long, n long"))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


# --- media --------------------------------------------------------------------------------------


def brute_media(text):
    """All columns of a text, pixel by pixel."""
    data = (text or "").encode()
    payload = data + b"\0" * ((-len(data)) % 64 or (64 if not data else 0))
    height = len(payload) // 64
    stored = b"P5\n64 %d\n255\n" % height + payload
    pixels = [payload[64 * y : 64 * y + 64] for y in range(height)]

    def resized(rows, cols):
        out = np.zeros((rows, cols))
        for r in range(rows):
            for c in range(cols):
                y0, y1, x0, x1 = height * r / rows, height * (r + 1) / rows, 64 * c / cols, 64 * (c + 1) / cols
                total = 0.0
                for y in range(int(y0), min(height, math.ceil(y1))):
                    for x in range(int(x0), min(64, math.ceil(x1))):
                        total += pixels[y][x] * max(0.0, min(y1, y + 1) - max(y0, y)) * max(0.0, min(x1, x + 1) - max(x0, x))
                out[r, c] = total / ((y1 - y0) * (x1 - x0))
        return out

    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), resized(*media.TILE), resized(*media.HASH_GRID)


def test_media_columns_against_pixels(spark):
    made = [(1, "Hello, media! " * 40, None), (2, None, None), (3, "", None), (4, "é日🙂" * 33, None), (None, "x" * 64, None), (5, "x" * 64, None), (6, "".join(chr(33 + i % 90) for i in range(3_000)), None)]
    got = media.text_media(table(spark, made)).collect()
    by = {(r.doc_id, r.payload_sha256): r for r in got}
    assert len(got) == len(made)
    for i, t, _ in made:
        n, size, sha, crc, stored, stored_sha, tile, grid = brute_media(t)
        r = by[i, sha]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (n, size, crc, stored, stored_sha)
        small = np.load(io.BytesIO(bytes(r.tile)), allow_pickle=False)
        assert small.shape == tile.shape and np.abs(small.astype(float) - tile).max() <= 0.5 + 1e-6
        bits = "".join("1" if b else "0" for b in (grid[:, 1:] > grid[:, :-1] + 1e-9).ravel())
        assert r.feature == f"{int(bits, 2):0{len(bits) // 4}x}:{hashlib.sha256(bytes(r.tile)).hexdigest()}"
    assert by[None, brute_media('x' * 64)[2]].feature == by[5, brute_media('x' * 64)[2]].feature


# --- near dedup and pipeline --------------------------------------------------------------------


def jaccard(a, b):
    a, b = (set(simhash.features(x or "", 5, True)) or {b""} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_of_a_large_group_and_chains(spark, monkeypatch):
    """A group in which most pairs are not similar, and a chain of texts each like the next."""
    monkeypatch.setattr(simhash, "PLAIN", 2)
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("bcdfglmnprst") + pick.choice("aeiou") for _ in range(3))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        other = list(base)
        for at in pick.sample(range(120), pick.randint(1, 9)):
            other[at] = word()
        rows.append((i, " ".join(other)))
    line = [word() for _ in range(400)]
    rows += [(1000 + i, " ".join(line[4 * i : 4 * i + 100])) for i in range(60)]
    texts = dict(rows)
    stay = {r.doc_id for r in simhash.keep_one(table(spark, [(i, t, "x") for i, t in rows])).collect()}
    assert all(max(jaccard(texts[i], texts[j]) for j in stay) >= 0.8 for i in texts if i not in stay)
    assert not [(i, j) for i in stay for j in stay if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    assert 1 < len(stay) < len(rows)


def test_signatures_leave_out_no_similar_pair():
    pick = np.random.default_rng(2)
    for n in (1, 5, 30, 200, 500, 2_000):
        for _ in range(60):
            a = pick.integers(0, 2**64, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 10] = pick.integers(0, 2**64, n // 10, dtype=np.uint64)
            one, both, bits = simhash.unlike(simhash.signature(np.unique(a)), simhash.signature(np.unique(b)))
            assert len(np.setxor1d(a, b)) >= one + bits and bits <= simhash.most_unlike(both, simhash.SURE)


def test_signatures_in_the_plan(spark):
    pick = np.random.default_rng(3)
    rows, want = [], []
    for k in range(80):
        n = int(pick.integers(1, 900))
        a = pick.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[: max(1, n - k)], pick.integers(0, 2**64, k, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        x, y = simhash.signature(a), simhash.signature(b)
        one, both, bits = simhash.unlike(x, y)
        rows.append((k, x.tolist(), y.tolist(), len(a), len(b)))
        want.append(9 * (one + bits) <= len(a) + len(b) and bits <= simhash.most_unlike(both, simhash.SURE))
    df = spark.createDataFrame(rows, "k int, mark_a array<long>, mark_b array<long>, size_a long, size_b long")
    assert [r.ok for r in df.select("k", simhash.may_be_alike(simhash.SURE).alias("ok")).orderBy("k").collect()] == want and 0 < sum(want) < 80


def test_pipeline_of_awkward_rows(spark, tmp_path):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("bcdfglmnprst") + pick.choice("aeiou") for _ in range(3))
    made = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 2}", 1, "extra", f"t{i}") for i in range(30)]
    long = " ".join(word() for _ in range(60_000))
    made += [(50, long, None, None, None, None, None), (50, long, None, None, None, None, None), (None, None, None, None, None, None, None), (51, "", "x", "s0", 0, "c", "t"), (52, None, None, "s1", 0, None, "t"), made[3], (None, made[4][1], "en", "s1", 1, "e", "f")]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, clean string, fp string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "clean", "fp"], name
    left = docs.collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [*range(30), 50, 51])) and {r.text for r in left if r.doc_id == 50} == {long}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(r.doc_id) for r in pieces} == {str(r.doc_id) for r in left}


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
