"""Document quality by histogram gradient-boosted trees over statistics of the text.

``features`` turns a text into numbers that say nothing about its id, source or language column. The trees are fitted on
a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``): values become bins by quantiles, each level of a tree takes
its splits from histograms of gradients over nodes, features and bins. Trees have all the same depth and lie in flat
arrays, so that a batch of documents walks down all trees by array indexing.

Null and empty texts have all features zero and get a score like any other. Without labelled rows, or with one class
only, the score of every text is the share of the class (one half without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import text_function, with_text
from feedlake.llm.labelled import SAMPLE_ROWS, held_out, training_rows

TREES, DEPTH, BINS, RATE, SMOOTH, LEAST_ROWS = 60, 4, 64, 0.2, 1.0, 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "exclaim": b"!",
            "bar": b"|", "symbol": b"#*$%&<>=+@^~\\{}[]", "stop": b".?", "comma": b",;:", "quote": b"\"'()"}
_KIND = np.zeros((len(_CLASSES), 256))
for _k, _bytes in enumerate(_CLASSES.values()):
    _KIND[_k, list(_bytes)] = 1
N_FEATURES = len(_CLASSES) + 14


def features(text: str) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    histogram = np.bincount(raw, minlength=256)
    size = len(raw)
    out[:len(_CLASSES)] = _KIND @ histogram / size
    share = histogram[histogram > 0] / size
    lengths = np.array(list(map(len, words)))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    k = len(_CLASSES)
    out[k:] = (
        n, size / n, lengths.std(), lengths.max(), (lengths <= 3).mean(), len(kinds) / n, max(kinds.values()) / n,
        pairs / max(1, n - 1), len(lines), size / len(lines), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(w[:1].isupper() for w in words) / n,
        -(share * np.log2(share)).sum())
    return out


@dataclass
class Trees:
    """Complete binary trees: node ``i`` has children ``2i + 1`` and ``2i + 2``; leaves are numbered from left to right."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        if len(self.leaf):
            trees = np.arange(len(self.leaf))
            at = np.zeros((len(x), len(trees)), dtype=np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.limit[trees, at])
            z += self.leaf[trees, at - (2 ** DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss."""
    none = Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    if not len(y):
        return none
    p = (y.sum() + 0.5) / (len(y) + 1)
    none.start = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, m = bins.shape
    z = np.full(n, none.start)
    feature, limit, leaf = (np.zeros((TREES, k), t) for k, t in ((2 ** DEPTH - 1, np.int64), (2 ** DEPTH - 1, float), (2 ** DEPTH, float)))
    limit[:] = np.inf
    for t in range(TREES):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            width = 2 ** level
            cell = ((node[:, None] * m + np.arange(m)) * BINS + bins).ravel()
            sums = [np.bincount(cell, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS) for v in (g, h, np.ones(n))]
            left = [s.cumsum(axis=2) for s in sums]
            right = [c[:, :, -1:] - c for c in left]
            gain = left[0] ** 2 / (left[1] + SMOOTH) + right[0] ** 2 / (right[1] + SMOOTH) - sums[0].sum(2, keepdims=True) ** 2 / (
                sums[1].sum(2, keepdims=True) + SMOOTH)
            gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                i = width - 1 + k
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, i], limit[t, i] = f, edges[f][b]
            i = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, i]] > limit[t, i])
        top, bottom = np.bincount(node, g, 2 ** DEPTH), np.bincount(node, h, 2 ** DEPTH)
        leaf[t] = RATE * top / (bottom + SMOOTH)
        z += leaf[t][node]
    return Trees(none.start, feature, limit, leaf)


def _features(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        yield (features(text),)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    sample = training_rows(docs, labels, "quality", rows).select(
        text_function(_features, {"x": "array<double>"})(F.col("text")).alias("f"), "label").select("f.x", "label").toArrow()
    x = np.array(sample.column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES)
    y = sample.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the rows come in any order: sums are taken in a fixed one
    return fit(x[order], y[order])


def quality_table(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))

    def run(texts: list[str]) -> Iterator[tuple]:
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES))
        return ((float(s),) for s in model.value.score(x))

    derived, name = with_text(docs.select("doc_id", "text"), text_function(run, {"score": "double"}))
    return derived.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{name}.score").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
