"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased characters make hashed 1-, 2- and 3-grams (runs of characters that aren't letters count
as one blank). Document frequencies come from all learnable rows; the regression is trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of them, and a
temperature fitted on sampled rows left out of training calibrates the scores.

Only the text and non-null language of rows that aren't held out are learned from. Null texts and
texts without a letter are ``und`` with score 1. Without any learnable row every text is ``und`` with
score 0. Ids may be null or repeated (each row is predicted and may be sampled by itself), texts of any
length are read whole, further columns don't matter; ties between languages go to the first in
alphabetical order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, sampled

DIMENSIONS = 1 << 14
#: Rows that the regression is trained and calibrated on, at most; one in five calibrates.
SAMPLE_ROWS, EPOCHS = 2_500, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c > 127) | ((c >= 97) & (c <= 122))
    c = np.where(letter, c, np.uint32(32))
    if len(c) > 1:
        c = c[np.concatenate([[True], letter[1:] | letter[:-1]])]
    total = np.zeros(DIMENSIONS, np.int64)
    key = np.zeros(len(c), np.uint32)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        key = (key[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]) * np.uint32(0x9E3779B1)
        total += np.bincount((key ^ np.uint32(n * 0x05EBCA6B)) >> np.uint32(18), minlength=DIMENSIONS)
    return total


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights, of length 1."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float(x @ x))
    return at, x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS x languages
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        at, x = tfidf(gram_counts(text), self.idf)
        p = softmax((x @ self.weights[at]) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal for the multinomial loss; weights are zero where L1 holds them."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = g * g
            z[at] = zz + g - (np.sqrt(nn + more) - np.sqrt(nn)) / ALPHA * w
            n[at] = nn + more
    return weights(z, n)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -float(np.log(softmax(logits / math.exp(t))[np.arange(len(y)), y] + 1e-12).mean())
    lo, hi, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from the rows that aren't held out. To the driver come DIMENSIONS document frequencies and
    at most SAMPLE_ROWS rows of hashed counts, never texts."""
    can = df.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    idf = _document_frequency(can)
    # a row's place is part of the hash, so that copies of one row aren't all below the bound
    order = F.xxhash64("id", "text", F.monotonically_increasing_id())
    sample = sampled(can, order, ["id", "lang", "text"], SAMPLE_ROWS).select(F.xxhash64("id", "text").alias("order"), "lang", "text")

    def start():
        def make(texts):
            out = []
            for t in texts:
                c = gram_counts(t)
                at = np.flatnonzero(c)
                out.append((at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            return list(zip(*out, strict=True)) if out else [[], []]

        return make

    got = sorted(map_rows(sample, ["order", "lang"], "text", "at binary, counts binary", start).collect(), key=lambda r: (r["order"], r["lang"], r["at"], r["counts"]))
    languages = sorted({r["lang"] for r in got})
    rows = []
    for r in got:
        counts = np.zeros(DIMENSIONS, np.int64)
        counts[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["counts"], "<u4")
        rows.append((*tfidf(counts, idf), languages.index(r["lang"])))
    if not rows:
        return Model([], np.zeros((DIMENSIONS, 0)), idf, 1.0)
    kept = [r for i, r in enumerate(rows) if i % 5] or rows
    left = [r for i, r in enumerate(rows) if i % 5 == 0]
    weights = ftrl(kept, len(languages))
    logits = np.array([x @ weights[at] for at, x, _ in left])
    return Model(languages, weights, idf, calibrate(logits, np.array([y for *_, y in left])))


def _document_frequency(can: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all learnable rows: each task sends one row a dimension at most."""
    import pyarrow as pa

    from .common import slices, spread, text_of

    def run(batches):
        total, rows = np.zeros(DIMENSIONS + 1, np.int64), 0
        for part in slices(batches):
            for t in part.column(0).to_pylist():
                total[:-1] += gram_counts(t) > 0
                rows += 1
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "df"])

    given = spread(can.select(text_of("text").alias("text")))
    got = given.mapInArrow(run, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()  # DIMENSIONS + 1 rows at most
    df = np.zeros(DIMENSIONS + 1)
    for r in got:
        df[r["at"]] = r["df"]
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def identify(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out boolean, lang_pred string, score double), one row a row."""

    def start():
        def make(texts):
            made = [model.predict(t) for t in texts]
            return list(zip(*made, strict=True)) if made else [[], []]

        return make

    made = map_rows(df, [id_col], text_col, "lang_pred string, score double", start, text_null=True)
    return made.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
