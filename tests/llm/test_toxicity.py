"""The clause grammar against an enumeration of all paths, and the operator on awkward rows."""

import itertools
import random

from quillwork.llm import toxicity as T

STAGES = (T.NEGATION, T.REPORT, T.TARGET, T.THREAT, T.INSULT)


def paths(machine, symbols):
    """Every accepted path: (string put out, weight)."""
    for start in machine.starts:
        open_paths = [(start, "", 0.0)]
        for s in symbols:
            open_paths = [(to, out + o, w + more) for state, out, w in open_paths for o, more, to in machine.arcs[state].get(s, ())]
        yield from ((out, w) for state, out, w in open_paths if state in machine.final)


def brute(symbols):
    """One transducer after the other, without composing them."""
    strings = {(symbols, 0.0)}
    for machine in STAGES:
        strings = {(out, w + more) for s, w in strings for out, more in paths(machine, s)}
    return max((w for _, w in strings), default=0.0)


def test_composed_grammar_against_all_paths():
    pick = random.Random(4)
    alphabet = T.SYMBOLS[:8] + ["3", "6"]
    clauses = ["".join(c) for n in (0, 1, 2, 3) for c in itertools.product("onrpmt25", repeat=n)]
    clauses += ["".join(pick.choice(alphabet) for _ in range(pick.randint(4, 9))) for _ in range(600)]
    assert all(abs(T.best_path(c) - brute(c)) < 1e-9 for c in clauses)
    assert any(T.best_path(c) > 3 for c in clauses)


def test_targets_reports_and_negations_on_either_side():
    weigh = lambda text: T.Lexicon().clause(text.split())
    assert weigh("you are an idiot") == weigh("an idiot are you") > weigh("that idiot there")
    assert weigh("that idiot there") > weigh("he said that idiot there") - T.UNIT * T.TARGET_GAIN == weigh("that idiot there he said") - T.UNIT * T.TARGET_GAIN
    assert weigh("that is not an idiot") < weigh("that is an idiot")
    assert weigh("not that any of it matters to an idiot") == weigh("that matters to an idiot")
    assert weigh("i will kill you") > weigh("i kill you") > weigh("i will kill time") == 0.0
    assert weigh("i will never kill you") == weigh("nothing to see") == weigh("") == 0.0


def test_runs_of_other_words_are_cut_without_effect():
    lexicon = T.Lexicon()
    words = ["not", *["so"] * 9, "idiot", *["la"] * 12, "you"]
    assert T.best_path("".join(map(lexicon.symbol, words))) == lexicon.clause(words)


def test_stems_are_learned_by_texts_that_hold_two_forms():
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("bdfgklmnprst") + pick.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(300):
        words = [word() for _ in range(60)]
        bad = i % 6 == 0
        words += ["vexqua" + word()[:2] for _ in range(4)] if bad else ["vexqua" + word()[:2]] * (i % 11 == 0)
        rows.append((words, int(bad)))
    lexicon = T.learn_arcs(rows)
    assert any("vexqua".startswith(s[:6]) for s in lexicon.stems) and len(lexicon.stems) == 1


def test_awkward_rows(spark):
    bad = "You are an idiot. What a pathetic clown you are."
    made = [(i, "calm words stand here " * 4 + (bad if i % 4 == 0 else ""), "x") for i in range(120)]
    long = "calm words stand here. " * 60_000
    made += [(None, None, None), (None, bad, "x"), (500, "", "x"), (501, long, "x"), (502, long + bad * 3, "x"), (4, "calm words with a known id", "x")]
    df = spark.createDataFrame([(i, t, x, t, 1.0, 0) for i, t, x in made], "doc_id long, text string, lang string, words string, score double, __y int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(0, 1), (0, 0), (None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    lexicon = T.train(df, labels)
    got = T.score(df, lexicon)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(made)
    trigger = lexicon.trigger()
    want = sorted((str(i), round(lexicon.score(t or "", trigger), 12)) for i, t, _ in made)
    assert sorted((str(r.doc_id), round(r.score, 12)) for r in got.collect()) == want
    kept = T.keep_clean(df, lexicon)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, _ in made if lexicon.score(t or "", trigger) < T.THRESHOLD)
    assert {str(r.doc_id) for r in kept.collect()} >= {"1", "500", "501", "4"} and 502 not in {r.doc_id for r in kept.collect()}


def test_without_labels_the_prior_grammar_scores(spark):
    df = spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "calm")], "doc_id long, text string")
    lexicon = T.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in T.score(df, lexicon).collect()} == {1: 1, 2: 0}
