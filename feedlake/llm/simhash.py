"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most three. Cut in two halves of 32 bits, such
a pair differs in at most one bit in one of the halves. In each half the anchors are the words of a perfect code: the
Hamming code on 31 bits, with the last bit free. It covers all 32-bit values with radius one, so every half has a home
anchor at distance one at most. A half within one bit of it lies within two bits of that anchor. Every fingerprint is
therefore replicated to all anchors within the covering radius plus the threshold, two bits (at most 17 anchors a half),
and home fingerprints meet the replicas of the same anchor in an equi-join: no pair is missed, and none is built outside
one anchor.

Only distinct fingerprints are compared, so copies cost nothing: a group of copies is one value. A value has at most
``C(64, <= 3)`` neighbours however large the corpus is. Groups are components of links, found by rounds of joins.

Texts without words (null, empty, blank) have fingerprint zero and link like any other. Rows are grouped by fingerprint,
so repeated rows and repeated ids are kept; a component whose ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch, text_function, unused, with_text
from feedlake.llm.components import connected_components
from feedlake.llm.near_copies import near_groups, text_id, text_sets
from feedlake.session import measured_only

SEED = 42
THRESHOLD = 3


def fingerprint(words: list[bytes], size: int = 3) -> int:
    """Majority of the bits of the XXH64 values of all shingles, as a signed 64-bit number."""
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        yield (fingerprint(text.encode().lower().split()),)


simhash = text_function(_fingerprints, {"fp": "long"})

# Bit i (from 1) of a half belongs to check j if i has bit j set: the parity checks of the Hamming code on 31 bits.
_CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
_FREE = 1 << 31


def _flip(value: Column, bit: Column) -> Column:
    return value.bitwiseXOR(F.pow(F.lit(2.0), bit - 1).cast("long"))


def _syndrome(half: Column) -> Column:
    """The position of the bit that separates a value from its code word; 0 for a code word."""
    return sum(((F.bit_count(half.bitwiseAND(F.lit(m))) % 2) * (1 << j) for j, m in enumerate(_CHECKS)), F.lit(0)).cast("int")


def home_anchor(half: Column) -> Column:
    """The anchor within one bit of a 32-bit value (its free bit is kept)."""
    syndrome = _syndrome(half)
    return F.when(syndrome == 0, half).otherwise(_flip(half, syndrome))


def near_anchors(half: Column) -> Column:
    """Array of all anchors within two bits of a 32-bit value, the home anchor included."""
    syndrome = _syndrome(half)
    home = home_anchor(half)
    # Code words at distance two: flip i and j with i xor j = syndrome. A code word itself has none.
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (syndrome != 0) & (i < i.bitwiseXOR(syndrome)))
    second = F.transform(pairs, lambda i: _flip(_flip(half, i), i.bitwiseXOR(syndrome)))
    return F.concat(F.array(home, home.bitwiseXOR(F.lit(_FREE))), second)


def near_links(fps: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: all pairs of the distinct values in ``fps (fp)`` that differ in at most three bits.

    A value has up to 34 replicas: they are never sent to all tasks, and sizes of joins are measured from then on.
    """
    measured_only(fps.sparkSession)
    halves = (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    tags = [F.lit(k << 32) for k in range(2)]
    home = fps.select(F.col("fp").alias("p"), F.explode(F.array(*(home_anchor(h) + t for h, t in zip(halves, tags, strict=True)))).alias("anchor"))
    # Both halves' lists, the second moved out of the range of the first.
    low, high = map(near_anchors, halves)
    other = fps.select(F.col("fp").alias("q"), F.explode(F.concat(low, F.transform(high, lambda x: x + tags[1]))).alias("anchor"))
    near = home.join(other, "anchor").filter((F.col("p") != F.col("q")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= THRESHOLD))
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def simhash_groups(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Stored ``(doc_id, fp)`` of every row, and ``(fp, label, component_id)`` of every distinct fingerprint."""
    derived, name = with_text(docs.select("doc_id", "text"), simhash)
    rows = scratch.store(derived.select("doc_id", F.col(f"{name}.fp").alias("fp")), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = scratch.store(near_links(values.select("fp")), "links")
    labels = connected_components(links, scratch)
    # Stored, so that the join on a label can split the label of a huge component.
    smallest = scratch.store(values.join(labels, values.fp == labels.node).groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    linked = labels.join(smallest, "label").select(F.col("node").alias("fp"), "label", "component_id")
    return rows, values.join(linked, "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "first_id").alias("component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, groups = simhash_groups(docs, scratch)
    # Stored, so that the join can split a fingerprint that very many copies share.
    groups = scratch.store(groups, "groups")
    scratch.drop("links", "smallest")
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_pairs(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of the sets in ``ids (key, fp)`` whose fingerprints are in one component: each with the least set of its
    component, so that there are no more pairs than sets."""
    links = scratch.store(near_links(ids.select("fp").distinct()), "fp-links")
    labels = connected_components(links, scratch, "fp-labels")
    named = ids.select("fp", "key").distinct().join(labels, F.col("fp") == labels.node, "left").select(
        F.coalesce("label", "fp").alias("label"), "key").distinct()
    named = scratch.store(named, "fp-named")
    leads = scratch.store(named.groupBy("label").agg(F.min("key").alias("a")), "fp-leads")
    return named.join(leads, "label").filter("a <> key").select("a", F.col("key").alias("b")).distinct()


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, with all columns: the one with the smallest id.

    Fingerprints propose what may be near: each set of shingles is held against the least one of its component of
    fingerprints (``simhash_pairs``). An exact check follows (``near_copies``: 80 % of five-word shingles), which also finds the
    pairs that differ in more bits. Rows with the same id (or all ids null) are told apart by a hash of the text, then
    arbitrarily but once: the choice is stored before it is applied.
    """
    measured_only(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    ids = text_sets(docs, scratch, fp=simhash)
    near = near_groups(docs, scratch, ids, simhash_pairs(ids, scratch))
    text, key, label, cid, rank = (unused(docs, x) for x in ("_text", "_key", "_label", "_component", "_rank"))
    known = docs.withColumn(text, text_id())
    names = ids.select(F.col("id").alias(text), F.col("key").alias(key))
    # The smallest id of each text, then of its set, then of its component; texts stay out of these joins.
    firsts = known.groupBy(text).agg(F.min("doc_id").alias("first_id"))
    values = scratch.store(names.join(firsts, text).groupBy(key).agg(F.min("first_id").alias("first_id")), "values")
    named = values.join(near.select(F.col("key").alias(key), F.col("label").alias("near")), key, "left").select(
        key, F.coalesce("near", key).alias(label), "first_id")
    named = scratch.store(named, "named")
    smallest = scratch.store(named.groupBy(label).agg(F.min("first_id").alias(cid)), "smallest")
    groups = scratch.store(names.join(named, key).join(smallest, label).select(text, label, cid), "groups")
    # Rank limits prune each partition before the shuffle; the winner has the component's id, null if all are.
    candidates = known.join(groups, text).filter(F.col("doc_id").eqNullSafe(F.col(cid)))
    order = Window.partitionBy(label).orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    return candidates.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(text, label, cid, rank)
