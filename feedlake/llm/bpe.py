"""Byte-level BPE by two lookups: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The ranks come from a public vocabulary file, read once on the driver and broadcast (its size is fixed by the file, not
by the corpus). Each pre-token is first looked up as a whole: ``PerfectHash`` gives every vocabulary entry its own slot
among exactly as many slots, so one probe and one comparison decide. Pre-tokens outside the vocabulary are merged pair by
pair: bytes form a linked list, a heap yields the pair of lowest rank, leftmost first.

Null and empty texts have no tokens and decode to nothing. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from feedlake.llm.common import text_function, with_text

#: Encodings of pre-tokens that a worker remembers; beyond that it forgets all and starts anew. Results do not depend on it.
REMEMBERED = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
    pairs.sort(key=lambda p: p[1])
    if [r for _, r in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be numbered from 0 without gaps")
    return [k for k, _ in pairs]


class PerfectHash:
    """Minimal perfect hash of a fixed set of keys: hash to a bucket, then displace the bucket's keys to free slots."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        self.buckets = b = max(1, n)
        where = (h % np.uint64(b)).astype(np.int64)
        members: dict[int, list[int]] = {}
        for i, w in enumerate(where.tolist()):
            members.setdefault(w, []).append(i)
        self.shift = np.zeros(b, dtype=np.int64)
        self.key_at = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        values = h.tolist()
        for w in sorted(members, key=lambda x: -len(members[x])):
            own = members[w]
            if len(own) == 1:
                continue
            d = 0
            while True:
                slots = [self._slot(values[i], d) for i in own]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[w] = d
            for i, s in zip(own, slots, strict=True):
                free[s] = False
                self.key_at[s] = i
        # Buckets of one key point straight at a free slot.
        rest = iter(np.flatnonzero(free).tolist())
        for w, own in members.items():
            if len(own) == 1:
                s = next(rest)
                self.shift[w] = -1 - s
                self.key_at[s] = own[0]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def probe(self, keys: list[bytes]) -> list[int]:
        """Index of the only entry that may equal each key; the caller compares."""
        if not self.n:
            return [-1] * len(keys)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            x = h ^ (np.maximum(d, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) % np.uint64(self.n)
        return self.key_at[np.where(d < 0, -1 - d, x.astype(np.int64))].tolist()


class Tokenizer:
    def __init__(self, entries: list[bytes], pattern: str):
        self.entries = entries
        self.ranks = {k: i for i, k in enumerate(entries)}
        self.whole = PerfectHash(entries)
        # White space as Unicode has it; the module's own class takes in four more control characters.
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self._start()

    def _start(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry itself: lowest rank first, leftmost of equals first.

        ``ends[i]`` is the end of the part that starts at byte ``i`` (0 once it was swallowed), which links the parts
        forwards; ``before`` links them backwards. A heap item packs rank, start and end of a pair; it is stale unless
        two neighbouring parts still span exactly that stretch.
        """
        get = self.ranks.get
        n = len(piece)
        wide = n.bit_length()
        low = (1 << wide) - 1
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(((r << wide) | i) << wide) | i + 2 for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            end = x & low
            i = x >> wide & low
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := get(piece[i:ends[end]])) is not None:
                    push(heap, (((r << wide) | i) << wide) | ends[end])
            k = before[i]
            if k >= 0 and (r := get(piece[k:end])) is not None:
                push(heap, (((r << wide) | k) << wide) | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:ends[i]]])
            i = ends[i]
        return out

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        entries, memo = self.entries, self.memo
        for piece, key, at in zip(pieces, raw, self.whole.probe(raw), strict=True):
            ids = [at] if at >= 0 and entries[at] == key else self.merge(key)
            memo[piece] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        new = [p for p in set(pieces) if p not in self.memo]
        if new:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
                new = list(set(pieces))
            self._learn(new)
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast(Tokenizer(read_ranks(path), pattern))


def token_digests(docs: DataFrame, tokenizer: Broadcast) -> DataFrame:
    """``doc_id``, number of ids, and hashes of the ids and of the bytes they decode to, of every row."""

    def digest(texts: list[str]) -> Iterator[tuple]:
        own = tokenizer.value
        for text in texts:
            ids = own.encode(text)
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    fn = text_function(digest, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
    derived, name = with_text(docs.select("doc_id", "text"), fn)
    return derived.select("doc_id", f"{name}.*")


def encode_table(docs: DataFrame, tokenizer: Broadcast) -> DataFrame:
    """``docs`` without the text, with ``n_tokens`` and ``token_ids`` (columns of those names are replaced)."""

    def encode(texts: list[str]) -> Iterator[tuple]:
        own = tokenizer.value
        for text in texts:
            ids = np.frombuffer(own.encode(text), dtype="<u4").astype(np.int32)
            yield len(ids), ids

    fn = text_function(encode, {"n_tokens": "long", "token_ids": "array<int>"})
    derived, name = with_text(docs, fn)
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "token_ids")]
    return derived.select(*rest, f"{name}.n_tokens", f"{name}.token_ids")


def decode_table(tokens: DataFrame, tokenizer: Broadcast) -> DataFrame:
    """``doc_id`` and ``text`` of a table with ``token_ids``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer.value
        for batch in batches:
            ids = batch.column("token_ids").to_pylist()
            texts = [None if x is None else own.decode(np.array(x, dtype="<u4").tobytes()).decode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")
