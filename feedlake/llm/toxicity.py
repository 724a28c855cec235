"""Toxic passages as maximum-scoring segments of token log-odds.

Words get the log-odds of appearing in toxic against other documents, with a Dirichlet prior: a constant and a share of a
word's frequency in both together as pseudo-counts. What is counted are distinct contexts (the words before and after), so
that a passage repeated in many copies of a document counts once. Words whose log-odds reach ``LEAST_WEIGHT`` and exceed
zero by ``LEAST_Z`` standard errors keep their value; all other words share one negative value, the drift. A linear scan finds all maximal scoring
segments of a text: each is a passage with more weight than any extension or part of it.

Scores of the best segment of random text follow an extreme-value law, ``P(S >= x) = 1 - exp(-K n exp(-decay x))`` for
``n`` words. ``decay`` solves ``sum p_s exp(decay s) = 1`` over the scores of words in non-toxic documents, ``K`` is read
from the segments of those documents. The evidence of a document adds up, over its passages, how far below one the
expected number of such chance passages lies (as a logarithm). A logistic curve over the evidence, fitted on the same
sample, gives the score.

Learning uses a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``). Null and empty texts have no passages.
Without labelled rows, or without one toxic and one other row, no word has weight and every score is one half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch, text_function, with_text
from feedlake.llm.labelled import SAMPLE_ROWS, held_out, training_rows

PRIOR, PRIOR_SHARE, LEAST_Z, LEAST_WEIGHT, LEAST_COUNT, DRIFT = 0.5, 0.05, 4.0, 1.5, 5, 0.05
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first word, last word, score)``, in one pass over the scored words.

    ``hits`` are ``(word number, positive score)``; each word between them costs ``drift``. Candidates are kept with the
    running totals before and after them; a new one swallows those it can extend with gain.
    """
    kept: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for place, score in hits:
        total -= drift * (place - at)
        low, high = total, total + score
        total, at = high, place + 1
        first = place
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, place, low, high))
    return [(a, b, high - low) for a, b, low, high in kept]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    start: float = 0.0

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        get = self.weights.get
        return len(words), segments([(i, s) for i, w in enumerate(words) if (s := get(w))])

    def evidence(self, n: int, scores: list[float]) -> float:
        """Minus the logarithm of the expected number of chance passages as strong, over all passages rarer than one."""
        return sum(max(0.0, self.decay * s - math.log(self.k * n)) for s in scores)

    def score(self, text: str) -> tuple[float, int, float]:
        """Score, number of passages, best passage."""
        n, found = self.passages(text)
        scores = [s for *_, s in found]
        z = self.start + self.slope * self.evidence(n, scores)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), len(found), max(scores, default=0.0)


def _solve_decay(rates: list[tuple[float, float]], drift: float) -> float:
    """The positive root of ``sum p exp(decay s) = 1``; ``rates`` holds (probability, positive score)."""
    rest = 1 - sum(p for p, _ in rates)

    def value(x: float) -> float:
        return rest * math.exp(-x * drift) + sum(p * math.exp(min(700.0, x * s)) for p, s in rates) - 1

    low, high = 1e-9, 1.0
    while value(high) < 0 and high < 1e6:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a little shrinkage; the slope is not negative."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    shrink = np.array([1e-3, 1e-2])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(shrink), a.T @ (y - q) - shrink * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _contexts(lexicon: set[str] | None):
    """Distinct words of a text, or the distinct contexts of the words of a lexicon, as ``word before after``."""

    def run(texts: list[str]) -> Iterator[tuple]:
        for text in texts:
            words = words_of(text)
            if lexicon is None:
                yield list(set(words)), []
                continue
            around = ["", *words, ""]
            at = [i for i, w in enumerate(words) if w in lexicon]
            yield [words[i] for i in at], [f"{around[i]} {around[i + 2]}" for i in at]

    return text_function(run, {"words": "array<string>", "around": "array<string>"})


def _log_odds(counts: DataFrame, n1: float, n0: float) -> DataFrame:
    """Words of ``counts (word, y1, y0)`` that speak for the first class, with their weight."""
    total = F.lit(PRIOR_SHARE) * (F.col("y1") + F.col("y0")) + F.lit(PRIOR)
    y1, y0 = F.col("y1") + total, F.col("y0") + total
    weighed = counts.filter(F.col("y1") >= LEAST_COUNT).select(
        "word", (F.log(y1 / F.lit(n1)) - F.log(y0 / F.lit(n0))).alias("weight"), F.sqrt(1 / y1 + 1 / y0).alias("error"))
    return weighed.filter((F.col("weight") >= LEAST_WEIGHT) & (F.col("weight") > LEAST_Z * F.col("error"))).select("word", "weight")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.store(training_rows(docs, labels, "toxic", rows), "sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return Model()
    n1, n0 = float(sizes[1]), float(sizes[0])
    # First by documents, which leaves few words; then these by their contexts. A word needs LEAST_COUNT toxic documents
    # of the bounded sample to get here.
    kinds = sample.select("label", F.explode(_contexts(None)(F.col("text"))["words"]).alias("word"))
    counts = kinds.groupBy("word").agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"))
    first = {r["word"] for r in _log_odds(counts, n1, n0).collect()}
    places = sample.select("label", _contexts(first)(F.col("text")).alias("c")).select(
        "label", F.explode(F.arrays_zip(F.col("c.words").alias("word"), F.col("c.around").alias("around"))).alias("x"))
    counts = places.select("label", "x.word", "x.around").distinct().groupBy("word").agg(
        F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"))
    model = Model({r["word"]: r["weight"] for r in sorted(_log_odds(counts, n1, n0).collect())})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(texts: list[str]) -> Iterator[tuple]:
        for text in texts:
            n, found = shared.value.passages(text)
            yield n, [s for *_, s in found]

    rows_ = sample.select("label", text_function(scan, {"n": "long", "scores": "array<double>"})(F.col("text")).alias("s")).select(
        "label", "s.n", "s.scores").collect()
    other = [r for r in rows_ if r["label"] == 0]
    n_words = max(1, sum(r["n"] for r in other))
    scores = [s for r in other for s in r["scores"]] or [max(model.weights.values(), default=1.0)]
    mean = sum(scores) / len(scores)
    model.decay = _solve_decay([(min(0.5, (len(scores) + 1) / n_words), max(mean, 2 * DRIFT))], DRIFT)
    # Segments a word among the other documents, carried from their typical score to score zero.
    model.k = (len(scores) + 1) / n_words * math.exp(min(700.0, model.decay * mean))
    evidence = sorted((model.evidence(r["n"], r["scores"]), r["label"]) for r in rows_)
    model.start, model.slope = _logistic(*np.array(evidence, dtype=float).T)
    scratch.drop("sample")
    return model


def toxicity_table(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``n_passages`` and ``best_passage`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))

    def run(texts: list[str]) -> Iterator[tuple]:
        return (model.value.score(text) for text in texts)

    derived, name = with_text(docs.select("doc_id", "text"), text_function(run, {"score": "double", "n_passages": "long", "best_passage": "double"}))
    return derived.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{name}.score",
                          (F.col(f"{name}.score") >= 0.7).cast("int").alias("predicted"), f"{name}.n_passages", f"{name}.best_passage")


def passage_table(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each passage: ``doc_id``, first and last word (from 0), score."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))

    def run(texts: list[str]) -> Iterator[tuple]:
        for text in texts:
            found = model.value.passages(text)[1]
            yield tuple([f[i] for f in found] for i in range(3))

    fields = {"first_word": "array<int>", "last_word": "array<int>", "score": "array<double>"}
    derived, name = with_text(docs.select("doc_id", "text"), text_function(run, fields))
    return derived.select("doc_id", F.explode(F.arrays_zip(*(F.col(f"{name}.{k}").alias(k) for k in fields))).alias("x")).select("doc_id", "x.*")
