"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns a clause's words into symbols: insults by grade, threats, modal verbs, persons, negations
and words of reported speech. Five transducers rewrite such a string, one after the other:

* NEGATION lowers the grade of what stands within a few words after a negation, and voids threats;
* REPORT lowers grades in a clause of reported speech, whether the report comes before or after;
* TARGET raises grades in a clause that names a person, whether before or after;
* THREAT makes a threat a graded hit if a person follows it, of a higher grade after a modal verb;
* INSULT weighs the hits by their grades and accepts if there is one.

The last three guess: REPORT that there is (or isn't) a report, TARGET and THREAT that there is a person,
and a path whose guess fails isn't accepted. ``compose`` multiplies them into one transducer, and a clause
weighs what its best accepted path does. A document's weight is the sum over its distinct clauses, so that
repeats of one add nothing, and its score a logistic function of that weight and the text's length.

Insult forms and stems are learned from labels, beside a short list of plain words. Only clauses around a
word that may weigh are walked, the others have no accepted path.

Null texts are the empty text, scored like any text without clauses. Ids may be null or repeated.
Labels that are null, or of unknown documents, teach nothing; of repeated labels the largest holds.
Without labels of both kinds the prior grammar scores. Rows are scored one by one, so that ties, repeated
rows, long texts and further columns don't matter.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_kept, map_rows, sampled, written

#: Labelled rows that the grammar is learned from, about and at most: by a hash of the id.
SAMPLE_ROWS = 6_000
THRESHOLD = 0.7
#: Least log-odds of a form or stem that becomes an insult arc; lengths of stems; distinct forms that a stem needs.
LEAST_ODDS, STEMS, STEM_FORMS = 2.5, (3, 4, 5, 6, 7), 4
#: Texts with an arc that no arc before explains: that many at least, and that share of the toxic ones; the
#: share if copies count.
LEAST_NEW, LEAST_SHARE, COPIED_SHARE = 2, 0.004, 0.02

# Symbols of the grammar; insults are digits, from "1" to the top grade.
OTHER, NEGATED, REPORTED, PERSON, MODAL, THREATENS, HIT = "o", "n", "r", "p", "m", "t", "x"
TOP, RAISED = 6, 7
GRADES = [str(g) for g in range(1, RAISED + 1)]
SYMBOLS = [OTHER, NEGATED, REPORTED, PERSON, MODAL, THREATENS, "0", *GRADES]
#: Words that a negation reaches; what negation and report take off a grade, and what a person adds.
SCOPE, NEGATION_COST, REPORT_COST, TARGET_GAIN = 3, 4, 2, 1
#: Grades of threats without and with a modal verb; weight of one grade.
THREAT_GRADES, UNIT = ("2", "4"), 0.5

# Plain insults, and words of the other symbols in four languages.
INSULTS = ("idiot", "moron", "scum", "stupid", "loser", "pathetic", "disgusting", "worthless", "trash", "clown", "imbecile", "vermin", "filth")
LEXICON = {
    THREATENS: ("kill", "murder", "hurt", "destroy", "shoot", "strangle", "töten", "umbringen", "tuer", "matar"),
    MODAL: ("will", "shall", "must", "should", "gonna", "going", "werde", "wird", "vais", "voy", "va"),
    PERSON: ("you", "your", "yours", "yourself", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "tu", "toi", "vous", "usted", "ellos"),
    NEGATED: ("not", "never", "no", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "pas", "jamais", "nunca"),
    REPORTED: ("said", "says", "wrote", "claimed", "quoted", "called", "sagte", "schrieb", "disait", "dijo"),
}
SYMBOL_OF = {w: s for s, words in LEXICON.items() for w in words}
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """arcs: state -> symbol -> (symbol put out, weight, next state) of each arc; final: states that accept."""

    starts: tuple
    arcs: dict
    final: frozenset


def transducer(starts: Iterable, step, final) -> Transducer:
    """The states reached from starts by step(state, symbol), which gives arcs; final(state) tells who accepts."""
    arcs, todo = {}, list(starts)
    while todo:
        state = todo.pop()
        if state not in arcs:
            arcs[state] = {s: found for s in SYMBOLS if (found := tuple(step(state, s)))}
            todo += [to for found in arcs[state].values() for _, _, to in found]
    return Transducer(tuple(starts), arcs, frozenset(s for s in arcs if final(s)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of a's output: pairs of states, weights added."""

    def step(state, symbol):
        for out, w, to in a.arcs[state[0]].get(symbol, ()):
            for out2, w2, to2 in b.arcs[state[1]].get(out, ()):
                yield out2, w + w2, (to, to2)

    return transducer([(p, q) for p in a.starts for q in b.starts], step, lambda s: s[0] in a.final and s[1] in b.final)


def moved(symbol: str, by: int) -> str:
    """A grade moved, down to 0 at least; other symbols stay."""
    return str(min(RAISED, max(0, int(symbol) + by))) if symbol in GRADES else symbol


def _negation(left: int, symbol: str):
    if symbol == NEGATED:
        yield symbol, 0.0, SCOPE
    else:
        held = moved(symbol, -NEGATION_COST) if symbol != THREATENS else OTHER
        yield held if left else symbol, 0.0, max(0, left - 1)


def _report(state: str, symbol: str):
    if state == "none":
        if symbol != REPORTED:
            yield symbol, 0.0, state
    else:
        yield moved(symbol, -REPORT_COST), 0.0, "met" if symbol == REPORTED else state


def _target(state: str, symbol: str):
    if state == "none":
        yield symbol, 0.0, state
    else:
        yield moved(symbol, TARGET_GAIN), 0.0, "met" if symbol == PERSON else state


def _threat(state: tuple[str, bool], symbol: str):
    stage, modal = state
    if stage == "none":
        yield OTHER if symbol == THREATENS else symbol, 0.0, state
    elif symbol == THREATENS:
        yield THREAT_GRADES[modal], 0.0, ("open" if stage == "want" else stage, modal)
    else:
        yield symbol, 0.0, ("met" if stage == "open" and symbol == PERSON else stage, modal or symbol == MODAL)


def _insult(state: str, symbol: str):
    if symbol in GRADES:
        yield HIT, UNIT * int(symbol), "hit"
    else:
        yield OTHER, 0.0, state


NEGATION = transducer([0], _negation, lambda s: True)
REPORT = transducer(["none", "want"], _report, lambda s: s != "want")
TARGET = transducer(["none", "want"], _target, lambda s: s != "want")
THREAT = transducer([("none", False), ("want", False)], _threat, lambda s: s[0] in ("none", "met"))
INSULT = transducer(["none"], _insult, lambda s: s == "hit")
GRAMMAR = reduce(compose, (NEGATION, REPORT, TARGET, THREAT, INSULT))


@lru_cache(1 << 16)
def best_path(symbols: str, grammar: Transducer = GRAMMAR) -> float:
    """Weight of the best accepted path of a clause, 0 if there is none."""
    reached = dict.fromkeys(grammar.starts, 0.0)
    for symbol in symbols:
        onward: dict = {}
        for state, weight in reached.items():
            for _, w, to in grammar.arcs[state].get(symbol, ()):
                if weight + w > onward.get(to, -math.inf):
                    onward[to] = weight + w
        reached = onward
    return max((w for s, w in reached.items() if s in grammar.final), default=0.0)


@dataclass
class Lexicon:
    """Words to symbols: forms and stems are insult arcs with their grades; scale is of the logistic score:
    intercept, and slopes of the logarithms of weight and length."""

    forms: dict[str, int] = field(default_factory=lambda: dict.fromkeys(INSULTS, TOP))
    stems: dict[str, int] = field(default_factory=dict)
    scale: tuple[float, float, float] = (-3.0, 4.0, 0.0)

    def symbol(self, word: str) -> str:
        if word in SYMBOL_OF:
            return SYMBOL_OF[word]
        grade = self.forms.get(word) or max((self.stems.get(word[:n], 0) for n in STEMS if len(word) > n), default=0)
        return str(grade) if grade else OTHER

    def symbols(self, words: list[str]) -> str:
        """Runs of other words beyond a negation's scope are alike, and are cut to its length."""
        return re.sub(f"{OTHER}{{{SCOPE},}}", OTHER * SCOPE, "".join(map(self.symbol, words)))

    def clause(self, words: list[str]) -> float:
        return best_path(self.symbols(words))

    def trigger(self) -> re.Pattern:
        """Whole words that are insults or threats, and words that begin with a stem."""
        whole = sorted({*self.forms, *LEXICON[THREATENS]}, key=lambda w: (-len(w), w))
        parts = [rf"(?:{'|'.join(map(re.escape, whole))})(?![^\W\d_])"]
        parts += [rf"(?:{'|'.join(map(re.escape, sorted(self.stems)))})(?=[^\W\d_])"] if self.stems else []
        return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})")

    def weight(self, text: str, trigger: re.Pattern) -> float:
        """Sum over the distinct clauses that hold a trigger."""
        low = text.lower()
        done, found = 0, {}
        for m in trigger.finditer(low):
            if m.start() < done:
                continue
            before = max(low.rfind(c, done, m.start()) for c in ".!?;:\n") + 1
            stop = CLAUSE_END.search(low, m.end())
            end = stop.start() if stop else len(low)
            words = WORD.findall(low, max(before, done), end)
            key = " ".join(words)
            if key not in found:
                found[key] = self.clause(words)
            done = end
        return sum(found.values())

    def features(self, text: str, trigger: re.Pattern) -> tuple[float, float]:
        return math.log1p(self.weight(text, trigger)), math.log1p(len(text))

    def score(self, text: str, trigger: re.Pattern) -> float:
        x, length = self.features(text, trigger)
        a, b, c = self.scale
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x + c * length))))


def _passage(words: Iterable[str]) -> tuple[int, ...]:
    """Alike for near copies: four minima of hashes of the words."""
    codes = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0]
    return tuple(min((c * m) & 0xFFFFFFFF for c in codes) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def learn_arcs(counts: Iterable[tuple[list[str], int]]) -> Lexicon:
    """Insult arcs from the distinct words of labelled texts.

    A form counts in a text that holds it, a stem in one that holds two forms of it: by chance a stem comes
    once. Candidates are of high smoothed log-odds, and are taken in order of the toxic texts that no arc
    taken before explains, less the clean ones they would add. Near copies of one text count once at first,
    since they share words that have nothing to do with it; what they are left with is learned from then.
    """
    lexicon = Lexicon()
    toxic, clean = [], []
    for words, y in counts:  # clean texts, which are many, stay strings: they are only read through
        toxic.append(frozenset(map(sys.intern, words))) if y == 1 else clean.append(" ".join(words))
    once = list({_passage(words): words for words in toxic}.values())
    _take_arcs(lexicon, once, clean, max(LEAST_NEW, LEAST_SHARE * len(once)))
    left = [words for words in toxic if not any(lexicon.symbol(w) in GRADES for w in words)]
    _take_arcs(lexicon, left, clean, max(LEAST_NEW, COPIED_SHARE * len(toxic)))
    return lexicon


def _take_arcs(lexicon: Lexicon, toxic: list[frozenset[str]], clean: list[str], least: float) -> None:
    n1, n0 = len(toxic), len(clean)
    if n1 < least or not n0:
        return

    def stems_of(words: Iterable[str], wanted=None) -> Counter:
        """Stem -> forms of it among the words."""
        return Counter(w[:n] for w in words for n in STEMS if len(w) > n and (wanted is None or w[:n] in wanted))

    def odds(a: int, b: int) -> float:
        return math.log((a + 0.1) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

    # counts first, and clean texts and places only for what may still become an arc
    vocabulary = Counter(w for words in toxic for w in words)
    forms = {w: n for w, n in vocabulary.items() if n > LEAST_NEW and w not in lexicon.forms and w not in SYMBOL_OF}
    varied = {s for s, n in stems_of(vocabulary).items() if n >= STEM_FORMS}
    twice = Counter(s for words in toxic for s, n in stems_of(words, varied).items() if n > 1)
    stems = {s: n for s, n in twice.items() if n >= LEAST_NEW}
    clean_forms, clean_once, clean_twice = Counter(), Counter(), Counter()
    for text in clean:
        words = set(text.split())
        clean_forms.update(words & forms.keys())
        for s, n in stems_of(words, stems).items():
            clean_once[s] += 1
            clean_twice[s] += n > 1
    forms = {w for w, n in forms.items() if odds(n, clean_forms[w]) >= LEAST_ODDS}
    stems = {s for s, n in stems.items() if odds(n, clean_twice[s]) >= LEAST_ODDS}
    at, once = defaultdict(set), Counter()
    for i, words in enumerate(toxic):
        for w in words & forms:
            at[False, w].add(i)
        for s, n in stems_of(words, stems).items():
            once[s] += 1
            if n > 1:
                at[True, s].add(i)
    open_texts = {i for i, words in enumerate(toxic) if words.isdisjoint(INSULTS)}

    def gain(arc: tuple[bool, str]) -> float:
        stem, key = arc
        return len(at[arc] & open_texts) - (clean_twice if stem else clean_forms)[key] * n1 / n0

    found = list(at)
    while found := [arc for arc in found if len(at[arc] & open_texts) >= least]:
        best = max(found, key=lambda arc: (gain(arc), not arc[0], len(arc[1]), arc[1]))
        if gain(best) <= 0:
            break
        stem, key = best
        seldom = odds(once[key], clean_once[key]) if stem else odds(len(at[best]), clean_forms[key])
        (lexicon.stems if stem else lexicon.forms)[key] = max(1, min(TOP, round(seldom)))
        open_texts -= at[best]


def fit_scale(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic coefficients for the columns of x, the first of which is 1, by damped Newton steps, slightly penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.array([1e-6] + [0.05] * (x.shape[1] - 1))
    loss = lambda v: float(np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + (penalty * v * v).sum() / 2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Lexicon:
    """Learn from SAMPLE_ROWS labelled rows at most that aren't held out. Only their distinct words, weights
    and lengths, and nothing of other rows, come to the driver."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    picked = sampled(known.filter(~held_out(F.col("__id"))), F.xxhash64("__id"), ["__id"], SAMPLE_ROWS)
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = written(given.join(F.broadcast(picked), "__id").select("__y", "__text"))  # picked: SAMPLE_ROWS ids at most
    start = lambda: lambda texts: [[" ".join(sorted(set(WORD.findall(t.lower())))) for t in texts]]
    words = sorted((r["words"], r["__y"]) for r in map_rows(rows, ["__y"], "__text", "words string", start).collect())
    lexicon = learn_arcs((text.split(), y) for text, y in words)
    trigger = lexicon.trigger()

    def weigh():
        return lambda texts: [list(c) for c in zip(*[lexicon.features(t, trigger) for t in texts], strict=True)]

    pairs = map_rows(rows, ["__y"], "__text", "weight double, length double", weigh).collect()
    if 0 < sum(r["__y"] for r in pairs) < len(pairs):
        pairs = sorted(tuple(r) for r in pairs)
        lexicon.scale = fit_scale(np.array([(1.0, w, n) for _, w, n in pairs]), np.array([y for y, *_ in pairs], float))
        if lexicon.scale[2] > 0:  # length alone must not make a text toxic: it only may excuse chance hits
            lexicon.scale = (*fit_scale(np.array([(1.0, w) for _, w, _ in pairs]), np.array([y for y, *_ in pairs], float)), 0.0)
    return lexicon


def _starter(lexicon: Lexicon):
    def start():
        trigger = lexicon.trigger()
        return lambda texts: [[lexicon.score(t, trigger) for t in texts]]

    return start


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out boolean, score double, predicted int), one row a row."""
    made = map_rows(df, [id_col], text_col, "score double", _starter(lexicon))
    return made.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows whose score is below THRESHOLD, columns unchanged."""
    return map_kept(df, text_col, "score double", _starter(lexicon), lambda made: made.filter(F.col("score") < THRESHOLD))
