"""The pipeline on a small corpus, stage by stage, against plain Python."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from quillwork.llm import common, packing, secrets, simhash, template_lines, toxicity

SHARED = "This line stands in many of the documents here"


def jaccard(a, b):
    a, b = (set(simhash.features(x or "", 5, True)) or {b""} for x in (a, b))
    return len(a & b) / len(a | b)


def corpus(spark, folder):
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("bcdfglmnprst") + pick.choice("aeiou") for _ in range(3))
    made = []
    for i in range(40):
        text = " ".join(word() for _ in range(60)) + ". "
        text += "You are an idiot and a moron. You idiot." if i % 10 == 3 else ""
        text += f"\n{SHARED}" if i % 4 == 0 else ""
        text += '\npassword = "hunter2hunter2"' if i % 7 == 0 else ""
        made.append((i, text, "en", f"s{i % 3}", len(text)))
    made += [(100, made[1][1], "en", "s0", 1), (101, made[2][1] + " extra", "en", None, 1), (102, None, None, None, None), (None, "lonely words without an id", "en", "s1", 3)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return made


def test_stages_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    docs = common.table(spark, folder, "documents")
    grammar = toxicity.train(docs, common.table(spark, folder, "labels"))
    trigger = grammar.trigger()
    want = {i: t for i, t, *_ in rows if grammar.score(t or "", trigger) < toxicity.THRESHOLD}
    assert not any(i is not None and i < 40 and i % 10 == 3 for i in want)

    stages = dict(corpus_pipeline.STAGES)
    clean = common.written(stages["toxicity"](spark, docs, folder))
    assert {r.doc_id: r.text for r in clean.collect()} == want and clean.columns == docs.columns

    holders = [i for i, t in want.items() if t and SHARED in t]
    assert len(holders) >= template_lines.MIN_DOCS
    for i in holders:
        if i != min(holders):
            want[i] = want[i].replace(f"\n{SHARED}", "")
    lines = common.written(stages["line dedup"](spark, clean, folder))
    got = {r.doc_id: r.text for r in lines.collect()}
    # the secret's line recurs as well: it stays where the id is least
    leaks = [i for i, t in want.items() if t and "password" in t]
    for i in leaks:
        if len(leaks) >= template_lines.MIN_DOCS and i != min(leaks):
            want[i] = want[i].replace('\npassword = "hunter2hunter2"', "")
    assert got == want and lines.columns == docs.columns

    order = sorted((i for i in want if i is not None)) + [None]
    root = {i: i for i in order}
    for n, a in enumerate(order):  # taken in order, a text stays unless it resembles one that stays
        for b in order[:n]:
            if root[b] == b and jaccard(want[a], want[b]) >= 0.8:
                root[a] = b
                break
    want = {i: want[i] for i in order if root[i] == i}
    assert 100 not in want and 101 not in want
    one = common.written(stages["near dedup"](spark, lines, folder))
    assert {r.doc_id: r.text for r in one.collect()} == want and one.columns == docs.columns

    scanner = secrets.SecretScanner()
    redacted = common.written(stages["secret scans"](spark, one, folder))
    got = {r.doc_id: r.text for r in redacted.collect()}
    assert set(got) == set(want) and all(t is None or not scanner.spans(t) for t in got.values())
    assert all(got[i] == t for i, t in want.items() if not t or not scanner.spans(t))

    coder = packing.text_coder(*packing.public_coder())
    whole = {}
    for r in sorted(stages["packing"](spark, redacted, folder).collect(), key=lambda r: r.start):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
    assert whole == {i: np.frombuffer(coder.encode(t or ""), coder.dtype).astype("<u4").tobytes() + (1).to_bytes(4, "little") for i, t in got.items()}


def test_run(spark, tmp_path):
    corpus(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and len({hashlib.sha256(r.ids).hexdigest() for r in got}) > 1
