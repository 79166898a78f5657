"""Line dedup against a brute-force version of its rule, on random corpora with ties, nulls and copies."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from quillwork.llm import template_lines as T

BLANKS = "\t\v\f\r" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = re.compile(f"[{BLANKS} ]+")


def parsed(line):
    """(n, leaf, form, tokens) of a line, None if it is empty."""
    words = SPACE.sub(" ", line).strip(" ").split(" ")
    if words == [""]:
        return None
    masked = [T.VARIABLE if re.search("[0-9]", w) else w for w in words]
    few = sum(w == T.VARIABLE for w in masked) <= (1 - T.SIMILARITY) * len(words)
    return len(words), (len(words), *masked[: T.LEAD]), tuple(masked if few else words), masked


def brute(rows):
    """What stays of each text, and the number of lines that go, by the text."""
    texts = {}
    for i, t in rows:
        if t is not None:
            mine = (i is not None, i or 0)
            texts[t] = min(texts.get(t, mine), mine)
    lines = {t: [parsed(x) for x in t.split("\n")] for t in texts}
    held = defaultdict(set)
    for t, found in lines.items():
        for p in found:
            if p:
                held[p[:3]].add(t)
    support = Counter()
    tokens = {p[:3]: p[3] for found in lines.values() for p in found if p}
    for p, at in held.items():
        if T.LEAD < p[0] < T.LONG:
            for k, w in enumerate(tokens[p]):
                support[p[1], k, w] += len(at)
    leaf_texts = Counter()
    for p, at in held.items():
        leaf_texts[p[1]] += len(at)
    group = {}
    for p, at in held.items():
        group[p] = ("line", *p)
        if T.LEAD < p[0] < T.LONG and leaf_texts[p[1]] >= T.MIN_DOCS:
            constant = [w != T.VARIABLE and (k < T.LEAD or support[p[1], k, w] >= T.MIN_DOCS) for k, w in enumerate(tokens[p])]
            rest = [(k, tokens[p][k]) for k, c in enumerate(constant) if c and k >= T.LEAD]
            if sum(constant) >= T.SIMILARITY * p[0] - 1e-9 and rest:
                group[p] = ("template", p[1], *rest)
    texts_of, first = defaultdict(set), {}
    for p, g in group.items():
        texts_of[g] |= held[p]
    out = {}
    for g, at in texts_of.items():
        first[g] = min(texts[t] for t in at)
    for t, found in lines.items():
        stay = []
        for raw, p in zip(t.split("\n"), found, strict=True):
            g = group[p[:3]] if p else None
            least = T.LONG_DOCS if p and p[0] >= T.LONG else T.MIN_DOCS
            if not p or len(texts_of[g]) < least or texts[t] == first[g]:
                stay.append(raw)
        out[t] = "\n".join(stay), len(found) - len(stay)
    return out


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: pick.choice("red blue old new cat dog sun sea oak ice".split())
    shared = [" ".join(word() for _ in range(pick.choice([1, 2, 3, 4, 6, 9, 49, 50, 60]))) for _ in range(14)]
    rows = []
    for i in range(60):
        made = []
        for _ in range(pick.randint(0, 7)):
            kind = pick.random()
            if kind < 0.35:
                made.append(pick.choice(shared))
            elif kind < 0.6:  # one field varies, without digits
                made.append(f"user {word()}x{word()} has logged in from the {pick.choice(['north', 'south', word()])} office at noon")
            elif kind < 0.7:
                made.append(f"order {pick.randint(1, 10**6)} was sent by mail on day {pick.randint(1, 30)} of this long month")
            elif kind < 0.78:
                made.append(" ".join(str(pick.randint(1, 4)) for _ in range(pick.choice([1, 2, 5]))))
            elif kind < 0.85:
                made.append("  \t" + pick.choice(shared).replace(" ", pick.choice([*BLANKS, "  "])) + "\r")
            elif kind < 0.9:
                made.append("")
            else:
                made.append(" ".join(word() + word() for _ in range(pick.randint(1, 12))))
        rows.append((i * 3 % 61, "\n".join(made)))
    rows += [(None, None), (500, None), (501, ""), (502, "\n\n"), rows[5], (600, rows[5][1]), (None, shared[0] + "\nno id"), (503, "一行没有空格的文字\n" + shared[2])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rule_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows) | {None: (None, 0)}
    assert 20 < sum(n > 0 for _, n in want.values())
    df = spark.createDataFrame([(i, t, "x", 7, t) for i, t in rows], "doc_id long, text string, h string, pos int, lines string").repartition(5)
    got = T.dedup_lines(df)
    assert got.columns == df.columns
    made = got.collect()
    assert Counter((r.doc_id, r.text) for r in made) == Counter((i, want[t][0]) for i, t in rows)
    assert Counter((r.doc_id, r.lines) for r in made) == Counter(rows)
    report = {(r.doc_id, r.n_lines, r.n_dropped, r.text_sha256) for r in T.line_report(df).collect()}
    assert report == {(i, 0 if t is None else len(t.split("\n")), want[t][1], hashlib.sha256((want[t][0] or "").encode()).hexdigest()) for i, t in rows}


def test_very_long_text(spark):
    long = "\n".join(f"{a}{b} stands here as a line of its own" for a in ("ab", "cd", "ef", "gh") for b in range(3000))
    rows = [(0, long)] + [(i, "the same short line recurs\n" + "w " * 30000) for i in range(1, 7)]
    got = {r.doc_id: r.text for r in T.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(rows)[t][0] for i, t in rows}


def test_unlike_templates_of_one_leaf(spark):
    """Templates that share count and lead stay apart; rows of numbers are no template."""
    rows = [(i, f"we have now {a} open seats in hall\nwe have now closed all {a} doors again\n{i} {i + 1} {i + 2}") for i, a in enumerate("ash elm fir oak yew box".split())]
    got = {r.doc_id: r.text for r in T.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1]} | {i: f"{i} {i + 1} {i + 2}" for i in range(1, 6)}
