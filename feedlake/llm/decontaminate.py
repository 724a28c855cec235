"""Benchmark decontamination by spaced seeds that tolerate substituted tokens.

Texts become lower-case word tokens. A document overlaps an item if, laid over each other in some offset, a window of
``WINDOW`` tokens (the whole item, if shorter) agrees in at least ``SIMILARITY`` of its positions; items with fewer than
``EXACT_BELOW`` tokens must agree in full, items without tokens overlap nothing.

``MASKS`` are fixed patterns: a one is a position that counts, a zero is ignored. The tokens under a mask are hashed at
every offset of the benchmark and of the documents, equal hashes join, and each hit fixes an offset of document against
item, around which windows are compared in full. The masks are chosen so that whatever positions of a window are
substituted within the tolerance, some mask lies on agreeing positions only: the join misses no overlap.

The benchmark is read in blocks of at most ``BLOCK_TOKENS`` tokens (an item alone may exceed it); the hashes of one block
are broadcast and all documents are scanned against it, so that what is broadcast does not grow with the benchmark, and
document hashes are never shuffled.

Null and empty texts overlap nothing. Repeated documents and repeated items give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import text_function, with_text

WINDOW, SIMILARITY, EXACT_BELOW = 20, 0.8, 8
MASKS = ("1111", "10111")
BLOCK_TOKENS = 200_000
WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def needed(length: int) -> int:
    """Positions of a window that must agree."""
    return length if length < EXACT_BELOW else -(-length * int(SIMILARITY * 100) // 100)


class Block:
    """Seeds of some benchmark items: sorted hashes with their places, and the items as numbers."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = [np.array([number(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64) for _, words in items]
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 62, max(map(len, MASKS)), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.seeds = []
        for mask in MASKS:
            keys, owner, place = [], [], []
            for k, item in enumerate(self.items):
                h, at = self._hash(item, mask)
                keys.append(h)
                owner.append(np.full(len(h), k))
                place.append(at)
            key, own, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owner, place))
            order = np.argsort(key, kind="stable")
            self.seeds.append((key[order], own[order], at[order]))
        # Items shorter than the shortest mask are compared as a whole.
        self.short = [k for k, item in enumerate(self.items) if 0 < len(item) < min(map(len, MASKS))]

    def _hash(self, words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens under the mask at every offset where all of them are known words, and those offsets."""
        n = len(words) - len(mask) + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = np.ones(n, dtype=bool)
        for i, c in enumerate(mask):
            if c == "1":
                known &= words[i:i + n] > 0
        at = np.flatnonzero(known)
        h = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, c in enumerate(mask):
                if c == "1":
                    h += words[at + i].astype(np.uint64) * self.factors[i]
        return h, at

    def overlaps(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, first token, number of tokens, agreeing tokens)`` of the best offset of every overlapping item."""
        get = self.vocabulary.get
        words = np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)
        offsets: set[tuple[int, int]] = set()
        for mask, (key, owner, place) in zip(MASKS, self.seeds, strict=True):
            h, at = self._hash(words, mask)
            low = np.searchsorted(key, h, "left")
            high = np.searchsorted(key, h, "right")
            for i in np.flatnonzero(high > low):
                for j in range(low[i], high[i]):
                    offsets.add((int(owner[j]), int(at[i]) - int(place[j])))
        for k in self.short:
            item = self.items[k]
            offsets.update((k, int(p)) for p in np.flatnonzero(words == item[0]))
        best: dict[int, tuple[int, int, int]] = {}
        for k, offset in sorted(offsets):
            found = self._verify(words, self.items[k], offset)
            if found and (k not in best or found[2] > best[k][2]):
                best[k] = found
        return [(k, *v) for k, v in sorted(best.items())]

    @staticmethod
    def _verify(words: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int] | None:
        size = min(WINDOW, len(item))
        first, last = max(0, -offset), min(len(item), len(words) - offset)
        if last - first < size:
            return None
        agree = item[first:last] == words[first + offset:last + offset]
        total = np.concatenate(([0], np.cumsum(agree)))
        good = np.flatnonzero(total[size:] - total[:-size] >= needed(size))
        if not len(good):
            return None
        # From the first to the last agreeing token of the windows that pass.
        inside = np.flatnonzero(agree[good[0]:good[-1] + size]) + good[0]
        start, end = int(inside[0]), int(inside[-1]) + 1
        return first + offset + start, end - start, int(total[end] - total[start])


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark as blocks of bounded size; one partition of it at a time is on the driver."""
    held: list[tuple[int | None, list[str]]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = tokens(row["text"] or "")
        if held and size + len(words) > BLOCK_TOKENS:
            yield Block(held)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield Block(held)


_FIELDS = {"item_ids": "array<long>", "starts": "array<int>", "sizes": "array<int>", "agreeing": "array<int>"}


def _search(docs: DataFrame, block: Block):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(texts: list[str]) -> Iterator[tuple]:
        own = shared.value
        for text in texts:
            found = own.overlaps(text)
            yield ([own.ids[f[0]] for f in found], *([f[i] for f in found] for i in (1, 2, 3)))

    return text_function(run, _FIELDS)


def overlap_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: where in the document, how many tokens, how many agree."""
    parts = []
    for block in blocks(benchmark):
        derived, name = with_text(docs.select("doc_id", "text"), _search(docs, block))
        found = derived.filter(F.size(f"{name}.item_ids") > 0).select("doc_id", F.explode(
            F.arrays_zip(*(F.col(f"{name}.{k}").alias(k) for k in _FIELDS))).alias("x"))
        parts.append(found.select(
            "doc_id", F.col("x.item_ids").alias("item_id"), F.col("x.starts").alias("first_token"),
            F.col("x.sizes").alias("n_tokens"), F.col("x.agreeing").alias("n_agreeing")))
    if not parts:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, item_id bigint, first_token int, n_tokens int, n_agreeing int")
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns."""
    for block in blocks(benchmark):
        derived, name = with_text(docs, _search(docs, block))
        docs = derived.filter(F.size(f"{name}.item_ids") == 0).drop(name)
    return docs
