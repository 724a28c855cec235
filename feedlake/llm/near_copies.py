"""Near copies by exact similarity: texts that share at least 80 % of their distinct five-word shingles (Jaccard).

Candidates come from prefixes. All shingles have one global order. If x is not larger than y and they are similar, at
least ``8/9 |x|`` and ``4/5 |y|`` shingles are common, so the first common one stands within the first
``|x| - ceil(8/9 |x|) + 1`` of x and the first ``|y| - ceil(4/5 |y|) + 1`` of y: an equi-join of the two prefixes misses
no pair. The order is by 64-bit hash, with frequent ones last: those whose place is marked in a table of ``2 ** PLACES`` bits. A
shingle is marked if its count in the first prefixes reaches the least count (``LEAST_FREQUENT`` or more) that no more than an
eighth of the places have. The table has one size for every corpus, and a rare shingle at a marked place only comes later: which
ones are marked changes the work but not the result. Each candidate is verified on the whole sets.

Pairs that another method proposes (``proposed``) are verified first, in the same way, and their components contracted: they save
work and can't change the result. Texts are known by a 64-bit hash that Spark computes, so that those of candidates are found
without shingling all texts anew.

Only distinct sets are compared, so copies cost nothing. Only components are wanted: in each round every shingle links its
sets to one of them, the components of the links so far are contracted, and shingles within one component are done. When
few pairs are left, when a round has not halved them, or after ``ROUNDS`` rounds, all pairs that are not yet in one component are verified.

Fewer than five words are one shingle; null texts count as empty, and texts without words are equal to each other. Repeated rows
are copies. An empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch, text_function, with_text
from feedlake.llm.components import connected_components

WORDS = 5
PLACES, BLOCK, LEAST_FREQUENT = 27, 16, 9
ROUNDS, COPIES_SPREAD = 6, 16


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words))], dtype="<u8").view("<i8")
    own = np.fromiter(map(digest, words), dtype="<u8", count=len(words))
    n = len(words) - WORDS + 1
    mixed = np.zeros(n, dtype="<u8")
    for k in range(WORDS):
        # Each place has its own odd factor; the shifts carry upper bits down.
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[k:k + n]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view("<i8"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def _sets(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        yield (xxhash.xxh64_intdigest(shingles(text).tobytes()) - (1 << 63),)


set_key = text_function(_sets, {"key": "long"})


def _place(hashes: np.ndarray) -> np.ndarray:
    return hashes.view("<u8") >> np.uint64(64 - PLACES)


def prefixes(frequent: np.ndarray | None):
    """The function from a text to the name of its set, its size and its prefix in the order that puts ``frequent`` places last."""
    def fn(texts: list[str]) -> Iterator[tuple]:
        for text in texts:
            own = shingles(text)
            size = len(own)
            first = own
            if frequent is not None:
                at = _place(own)
                late = (frequent[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                first = own[np.argsort(late, kind="stable")]
            yield xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), size, first[:size - -(-4 * size // 5) + 1]

    return text_function(fn, {"key": "long", "size": "long", "first": "array<long>"})


def _block(table: pa.Table) -> pa.Table:
    """The marked places of one block as bits."""
    at = table.column("place").to_numpy() & ((1 << BLOCK) - 1)
    bits = np.zeros(1 << BLOCK, dtype=np.uint8)
    bits[at] = 1
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def frequent_places(counts: DataFrame) -> np.ndarray:
    """Bits of the places of frequent shingles out of ``counts (s, n)``: a table of fixed size, put together block by block."""
    # How many shingles have each count, in steps of a power of two: a few dozen rows.
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("k")).collect()
    number, least = 0, None
    for r in sorted(steps, key=lambda r: -r.e):
        number += r.k
        if number > 1 << (PLACES - 3):
            least = 1 << (r.e + 1)
            break
    marked = counts.filter(F.col("n") >= max(least or 0, LEAST_FREQUENT)).select(F.shiftrightunsigned("s", 64 - PLACES).alias("place"))
    blocks = marked.withColumn("block", F.shiftright("place", BLOCK)).groupBy("block").applyInArrow(_block, "block long, bits binary").toArrow()
    table = np.zeros((1 << (PLACES - BLOCK), 1 << (BLOCK - 3)), dtype=np.uint8)
    for block, bits in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        table[block] = np.frombuffer(bits, dtype=np.uint8)
    return table.ravel()


def _verify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([similar(shingles(x or ""), shingles(y or "")) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


_verify.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def _candidates(x: DataFrame, y: DataFrame, same: list) -> DataFrame:
    """Pairs that may be similar by their sizes and by what can follow the common shingle; ``x`` is the smaller set."""
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    met = x.alias("x").join(y.alias("y"), [*same, F.col("x.label") != F.col("y.label")])
    fits = (5 * F.col("x.size") >= 4 * F.col("y.size")) & (9 * left >= 4 * (F.col("x.size") + F.col("y.size")))
    in_prefix = F.col("x.at") <= F.col("x.size") - F.ceil(8 * F.col("x.size") / 9)
    return met.filter((F.struct("x.size", "x.key") < F.struct("y.size", "y.key")) & fits & in_prefix).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each shingle's lead with its other sets: no more than there are rows. The lead changes from turn to turn."""
    lead = F.min(F.struct(*([F.xxhash64("key", F.lit(turn)).alias("h")] if turn else []), "size", "key", "at", "label"))
    leads = rows.groupBy("s").agg(lead.alias("lead")).select("s", "lead.key", "lead.size", "lead.at", "lead.label")
    same = [F.col("x.s") == F.col("y.s")]
    return _candidates(leads, rows, same).union(_candidates(rows, leads, same)).distinct()


def text_sets(docs: DataFrame, scratch: Scratch, **more: Callable[[Column], Column]) -> DataFrame:
    """Stored ``(id, key)`` of each distinct text, the hash of the text and the name of its set, with the results of ``more``
    functions of the text from the same pass."""
    derived, name = with_text(docs.select("text"), set_key)
    made = {k: fn(F.col("text")) for k, fn in more.items()}
    return scratch.store(derived.withColumns(made).select(
        text_id().alias("id"), F.col(f"{name}.key").alias("key"), *[F.col(f"{k}.{k}").alias(k) for k in made]).distinct(), "ids")


def text_id() -> Column:
    return F.xxhash64("text")


def _contracted(rows: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int, float]:
    """Rows under the labels so far, without shingles whose sets are all in one component: those have no pair left. With the
    numbers of rows and pairs that are left."""
    named = rows.drop("label").join(labels, rows["key"] == labels["node"], "left").select(
        "s", "key", "size", "at", F.coalesce("label", "key").alias("label"))
    named = scratch.store(named, f"named-{name}")
    parts = named.groupBy("s", "label").agg(F.count("*").alias("n")).groupBy("s").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside")).filter("parts > 1")
    parts = scratch.store(parts, f"parts-{name}")
    kept = scratch.store(named.join(parts.select("s"), "s"), f"rows-{name}")
    scratch.drop(f"named-{name}")
    left = parts.agg(F.sum("n").alias("rows"), F.sum((F.col("n").cast("double") * F.col("n") - F.col("inside")) / 2).alias("pairs")).first()
    return kept, left.rows or 0, left.pairs or 0


def near_groups(docs: DataFrame, scratch: Scratch, ids: DataFrame | None = None, proposed: DataFrame | None = None) -> DataFrame:
    """Stored ``(key, label)`` of each distinct set of shingles that is similar to another, by components.

    ``ids`` are the ``text_sets`` of ``docs``; ``proposed (a, b)`` are pairs of sets to verify before all others.
    """
    ids = text_sets(docs, scratch) if ids is None else ids
    texts = docs.select("text")
    derived, name = with_text(texts, prefixes(None))
    counts = scratch.store(derived.select(F.explode(f"{name}.first").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(
        F.col("n") >= LEAST_FREQUENT), "counts")
    derived, name = with_text(texts, prefixes(frequent_places(counts)))
    # One row for each set; then only shingles that stand in the prefixes of two sets.
    sets = derived.groupBy(f"{name}.key").agg(F.first(name).alias("p")).select("key", "p.size", F.posexplode("p.first").alias("at", "s"))
    sets = scratch.store(sets, "prefixes")
    several = sets.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select("s")
    rows, last = scratch.store(sets.join(several, "s").select("s", "key", "size", "at", F.col("key").alias("label")), "rows-all"), "rows-all"
    scratch.drop("prefixes", "counts")
    links, before = None, float("inf")
    if proposed is not None:
        links = _verified(proposed, docs, ids, scratch, "proposed")
        rows, _, _ = _contracted(rows, connected_components(links, scratch, "labels-proposed"), scratch, "proposed")
        scratch.drop(last)
        last = "rows-proposed"
    for turn in range(ROUNDS):
        more = _verified(_stars(rows, turn), docs, ids, scratch, f"star-{turn}")
        links = more if links is None else links.union(more)
        rows, n_rows, pairs = _contracted(rows, connected_components(links, scratch, f"labels-{turn}"), scratch, str(turn))
        scratch.drop(last)
        last = f"rows-{turn}"
        # Few pairs are left, or most of them are of sets that are not similar: further leads would not help.
        if pairs <= 2 * n_rows or pairs > before / 2:
            break
        before = pairs
    rest = _candidates(rows, rows, [F.col("x.s") == F.col("y.s")])
    links = links.union(_verified(rest.distinct(), docs, ids, scratch, "rest"))
    return scratch.store(connected_components(links, scratch, "all").withColumnRenamed("node", "key"), "near")


def _verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar; only texts of candidates travel."""
    pairs = scratch.store(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    # One text speaks for its set. Copies of it are dealt to several tasks, each of which keeps one.
    one = ids.join(wanted, "key").groupBy("key").agg(F.min("id").alias("id"))
    spread = one.select("id", "key", F.explode(F.sequence(F.lit(0), F.lit(COPIES_SPREAD - 1))).alias("part"))
    own = docs.select(text_id().alias("id"), (F.monotonically_increasing_id() % COPIES_SPREAD).cast("int").alias("part"), "text")
    single = own.join(spread, ["id", "part"]).groupBy("key", "part").agg(F.first("text").alias("text"))
    texts = scratch.store(single.groupBy("key").agg(F.first("text").alias("text")), f"{name}-texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    same = F.arrow_udf(_verify, "boolean").asNondeterministic()
    out = scratch.store(both.withColumn("same", same("ta", "tb")).filter("same").select("a", "b"), f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-texts")
    return out
