"""Removal of repeated 200-byte strings by distributed prefix doubling over sampled positions.

Prefix doubling names the strings that start at each position by pairs of names of shorter strings, sorts the pairs, and
drops a position once its name is unique; a position whose name is still shared at the threshold length is a repeat.
Here a name is a 64-bit polynomial value, so that a pair of names at an offset has a name of its own without a global
renumbering, and whole runs of positions go through the rounds as one row:

1.  Every window of 200 bytes elects an anchor, the leftmost of its 100-byte strings with the smallest name. Equal windows
    elect the same anchor at the same offset. Spark groups the anchors' names of length 100; unique ones are done: no
    window that elects them is repeated.
2.  For each shared anchor, the windows that elect it form a run. Runs whose joint string is shared are repeated as a
    whole. Where a name is shared but not all of its runs are equal, the run goes on in pieces of 13 windows, named at
    length 188 (what all windows of a piece have in common) and as a whole.
3.  Pieces that are still open go on window by window, named at the threshold length of 200.

A round groups ``(core, full)`` pairs: ``core`` is what all windows of the piece share, ``full`` is all they cover. A
shared ``full`` settles a piece as repeated; a ``core`` with one ``full`` only has nothing more to tell; the others, and
one witness of each shared ``full`` among them, go on. So only the edges of repeats reach the last round, and no round
holds a group in memory: all steps are aggregates and equi-joins, which split hot names.

Only distinct texts take part, weighed by their number of copies. A text is known by two hashes (96 bits). Names of
different strings collide with a chance of about 2**-64 a pair. Null and empty texts have no bytes; texts under 200 bytes
lose nothing; repeated rows count as repeats of each other, each row giving its own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch, text_function

LENGTH, GRAM, PIECE = 200, 100, 13
#: Windows that one pass over part of a text looks at; a longer text is cut into parts that overlap by a window.
PART = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = np.random.default_rng(200).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


class Names:
    """Names of all substrings of a byte string, equal for equal content wherever it stands."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, dtype=np.uint8)] * up[:n], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _salted(h: np.ndarray, *salts: np.ndarray) -> np.ndarray:
    for s in salts:
        h = _mixed(h + (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return h


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Extreme of each ``width`` neighbouring values: suffixes of one block meet prefixes of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, _TOP if best is np.minimum else 0, dtype=np.uint64)
    padded[:n] = values
    cut = padded.reshape(-1, width)
    before = best.accumulate(cut, axis=1).ravel()
    after = best.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[:n - width + 1], before[width - 1:n])


def elected(names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that elect the same anchor: name of the anchor, its place, first window, number of windows."""
    width = LENGTH - GRAM + 1
    h = names.all(GRAM)
    least = _sliding(h, width, np.minimum)
    n = len(least)
    around = np.zeros(n + 2 * (width - 1), dtype=np.uint64)
    around[width - 1:width - 1 + n] = least
    chosen = np.flatnonzero(h == _sliding(around, width, np.maximum))
    values = h[chosen]
    at = np.searchsorted(chosen, np.arange(n))
    open_ = np.flatnonzero(values[at] != least)
    while len(open_):
        at[open_] += 1
        open_ = open_[values[at[open_]] != least[open_]]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    place = chosen[at[first]]
    return h[place], place, first, size


def _parts(data: bytes) -> Iterator[tuple[int, bytes]]:
    for i in range(0, len(data) - LENGTH + 1, PART):
        yield i, data[i:i + PART + LENGTH - 1]


def _anchors(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        found = [elected(Names(part))[0] for _, part in _parts(text.encode())]
        if found:
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield values.view(np.int64), counts.astype(np.int32)
        else:
            yield [], []


_PIECE_TYPE = "k1 bigint, k2 bigint, core bigint, full bigint, place int, start int, size int, weight bigint"


def _runs(data: bytes, shared: np.ndarray, weight: int) -> list[np.ndarray]:
    """Pieces of the first round: one for each run of windows around a shared anchor."""
    out = []
    for base, part in _parts(data):
        names = Names(part)
        core, place, start, size = elected(names)
        keep = np.isin(core, shared)
        core, place, start, size = (x[keep] for x in (core, place, start, size))
        full = _salted(names.of(start, start + size - 1 + LENGTH), place - start, size)
        out.append(np.stack([core.view(np.int64), full.view(np.int64), place + base, start + base, size, np.full(len(size), weight)]))
    return out


def _cut(data: bytes, place: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray, piece: int) -> list[np.ndarray]:
    """The runs cut at multiples of ``piece`` windows before the anchor; each piece keeps the weight of its run."""
    out = []
    for base in range(0, len(data) - LENGTH + 1, PART):
        mine = (start >= base) & (start < base + PART)
        if not mine.any():
            continue
        names = Names(data[base:base + PART + 2 * LENGTH])
        at, lo, n, w = place[mine] - base, start[mine] - base, size[mine], weight[mine]
        # One row for each window, then the windows of a run with the same piece number are one piece.
        run = np.repeat(np.arange(len(n)), n)
        window = lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        number = (at[run] - window) // piece
        head = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (number[1:] != number[:-1]))))
        many = np.diff(np.concatenate((head, [len(run)])))
        p, s, k = at[run[head]], window[head], number[head]
        core = _salted(names.of(p - piece * k, p - piece * k - (piece - 1) + LENGTH), k)
        full = core if piece == 1 else _salted(names.of(s, s + many - 1 + LENGTH), p - s, many)
        out.append(np.stack([core.view(np.int64), full.view(np.int64), p + base, s + base, many, w[run[head]]]))
    return out


def _piece_rows(texts: DataFrame, work: str, make) -> DataFrame:
    """One row for each piece that ``make(bytes, value of the column work, weight)`` gives for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            weights, works = batch.column("weight").to_pylist(), batch.column(work)
            found, owner = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for part in make(text.encode(), works[k], weights[k]):
                    found.append(part)
                    owner.append(np.full(part.shape[1], k))
            if not found:
                continue
            cols, at = np.concatenate(found, axis=1), np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[at]) for c in keys), pa.array(cols[0]), pa.array(cols[1]), *(pa.array(c.astype(np.int32)) for c in cols[2:5]),
                 pa.array(cols[5])], names=["k1", "k2", "core", "full", "place", "start", "size", "weight"])

    return texts.select("k1", "k2", "weight", "text", work).mapInArrow(run, _PIECE_TYPE)


def _settle(pieces: DataFrame, scratch: Scratch, name: str, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Repeated pieces ``(k1, k2, start, size)``, and the pieces that go on with their weight as evidence."""
    fulls = pieces.groupBy("core", "full").agg(F.sum("weight").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("witness"))
    if last:
        shared = fulls.filter("times > 1").select("core", "full")
        return scratch.store(pieces.join(shared, ["core", "full"]).select("k1", "k2", "start", "size"), f"{name}-repeated"), None
    fulls = scratch.store(fulls, f"{name}-fulls")
    mixed = fulls.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core", F.lit(True).alias("mixed"))
    judged = fulls.join(mixed, "core", "left").filter("mixed OR times > 1")
    out = scratch.store(pieces.join(judged, ["core", "full"]).select(
        "k1", "k2", "place", "start", "size", (F.col("times") > 1).alias("repeated"), F.greatest("times", "weight").alias("weight"),
        (F.col("mixed") & ((F.col("times") == 1) | (F.col("witness") == F.struct("k1", "k2", "start")))).alias("open")), f"{name}-judged")
    return out.filter("repeated").select("k1", "k2", "start", "size"), out.filter("open")


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(k1, k2, starts, sizes)``: runs of repeated windows of every distinct text that has some."""
    known = docs.filter(F.octet_length("text") >= LENGTH)
    cores = text_function(_anchors, {"cores": "array<long>", "counts": "array<int>"})
    grams = known.withColumn("a", cores(F.col("text"))).select("k1", "k2", F.explode(F.arrays_zip(
        F.col("a.cores").alias("cores"), F.col("a.counts").alias("counts"))).alias("x")).select(
        "k1", "k2", F.col("x.cores").alias("core"), F.col("x.counts").alias("n"))
    grams = scratch.store(grams, "grams")
    shared = grams.groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1").select("core")
    # A set, because the copies of a text give the same names.
    wanted = scratch.store(grams.join(shared, "core").groupBy("k1", "k2").agg(F.collect_set("core").alias("cores")), "wanted")
    scratch.drop("grams")
    distinct = known.groupBy("k1", "k2").agg(F.count("*").alias("weight"), F.first("text").alias("text"))
    texts = scratch.store(distinct.join(wanted, ["k1", "k2"]), "texts")
    scratch.drop("wanted")
    pieces = scratch.store(_piece_rows(texts, "cores", lambda b, w, n: _runs(b, w.values.to_numpy().view(np.uint64), n)), "runs")
    done, going = _settle(pieces, scratch, "runs", False)
    repeated = [done]
    scratch.drop("runs", "runs-fulls")
    for name, size in (("pieces", PIECE), ("windows", 1)):
        work = going.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "start", "size", "weight")).alias("work"))
        pieces = scratch.store(_piece_rows(texts.join(work, ["k1", "k2"]), "work", _cutter(size)), name)
        done, going = _settle(pieces, scratch, name, size == 1)
        repeated.append(done)
        scratch.drop(name, f"{name}-fulls")
    runs = repeated[0].unionByName(repeated[1]).unionByName(repeated[2])
    out = scratch.store(runs.groupBy("k1", "k2").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes")), "removed")
    scratch.drop("texts", "runs-judged", "pieces-judged", "windows-repeated")
    return out


def _cutter(size: int):
    def make(data: bytes, work: pa.Scalar, weight: int) -> list[np.ndarray]:
        place, start, length, proof = (work.values.field(i).to_numpy().astype(np.int64) for i in range(4))
        return _cut(data, place, start, length, proof, size)

    return make


def _cover(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Maximal removed byte runs as rows ``(start, end)``."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + sizes - 1 + LENGTH)[order])
    head = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return np.stack([s[head], e[np.concatenate((head[1:] - 1, [len(s) - 1]))]], axis=1)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, starts, sizes in zip(batch.column("text").to_pylist(), batch.column("starts"), batch.column("sizes"), strict=True):
            data = (text or "").encode()
            at, kept, removed = 0, hashlib.sha256(), 0
            spans = [] if not starts.is_valid else _cover(
                len(data), starts.values.to_numpy().astype(np.int64), sizes.values.to_numpy().astype(np.int64)).tolist()
            parts = []
            for s, e in spans:
                parts.append(data[at:s])
                removed += e - s
                at = e
            parts.append(data[at:])
            left = b"".join(parts)
            kept.update(left)
            rows.append((len(data), removed, len(spans), kept.hexdigest(), left))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, byte counts, number of removed runs, hash of the bytes that stay, and those bytes, of every row."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("k1"), F.crc32(F.encode("text", "UTF-8")).alias("k2"))
    runs = repeated_runs(own.select("text", "k1", "k2"), Scratch(docs.sparkSession, "suffix-dedup"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "starts", "sizes").mapInArrow(
        _cut_out, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


#: The definition itself, over every window of every text.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400),
named AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS name FROM starts),
repeated AS (SELECT r, i FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) > 1)),
edges AS (SELECT r, i, coalesce(i > lag(i) OVER w + 200, true) AS opens FROM repeated WINDOW w AS (PARTITION BY r ORDER BY i)),
spans AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM edges) GROUP BY r, k),
gaps AS (SELECT r, s AS stop, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS since FROM (
    SELECT r, s, e FROM spans UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM d)),
kept AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (stop - since)), '' ORDER BY stop, since) AS k FROM gaps JOIN d USING (r) GROUP BY r),
sizes AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sizes USING (r)"""
