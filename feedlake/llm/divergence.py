"""How the sources of a language differ: exact divergence of term frequencies over run-length columns.

Terms are runs of letters (ASCII letters, lower-cased, and everything outside ASCII). One pass over the texts counts
them, combined in each task before the shuffle. A language keeps the terms that occur in at least ``LEAST_DOCS`` of its rows.

Every source of a language is a column over the kept vocabulary. The vocabulary is put into an order that lets equal
counts stand together (by the counts in the largest sources, then by a digest of all counts), cut into chunks of
``CHUNK`` positions, and each column becomes runs of equal values there; absent terms are runs, too. A pair of columns is compared where the
boundaries of their runs meet: the divergence ``f`` of two values counts as often as the stretch is long. A task
sees one chunk and two blocks of at most ``BLOCK`` sources, whatever the number of terms and sources; its sums are added up.

Null texts, languages and sources count as empty. Each row is a document, so repeated rows count again. Ties keep their
items in the order of their bytes. A group without terms, or in a language that keeps none, has all its pairs with value 0 or
by the smoothed frequencies, and no terms; a lone source has no pairs. Texts of any length are whole; an empty table gives no rows.
Columns other than ``text``, ``lang`` and ``source`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm import ranks
from feedlake.llm.common import Scratch

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Positions of a chunk and sources of a block: together they bound what a task compares at once.
CHUNK, BLOCK = 4096, 32
#: Sources whose counts order the vocabulary, and entries that a task holds before it hands them on.
LEADING, HELD = 12, 400_000

# Bytes that are no letters become blanks, capitals become small letters.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each group seen by this task, handed on whenever it holds ``HELD`` terms, and at the end."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
            words = terms(text or "")
            before = len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n) - before + 1
            if held > HELD:
                yield from _rows(counts)
                counts, held = {}, 0
    yield from _rows(counts)


def _rows(counts: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in counts.items():
        # The last row, without term, names the group itself.
        size = len(n) + 1
        yield pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size),
            pa.array([*n, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()),
            pa.array([*map(docs.__getitem__, n), 0], pa.int64())], schema=_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and rows; each group also has one row with a null term."""
    parts = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 size))`` in exact integers."""
    whole = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, (total + 2 * size).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; values are at most 10^9 + 1, so that the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Columns:
    """Stored tables of one corpus: ``groups (lang, source, idx, total, size, base)``, ``cells (lang, idx, term, pos, n, p, q)``."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.scratch = scratch
        counts = scratch.store(term_counts(docs), "counts")
        sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
        largest = Window.partitionBy("lang").orderBy(F.desc("words"), "source")
        named = scratch.store(sizes.withColumn("idx", (F.row_number().over(largest) - 1).cast("long")), "named")
        named_counts = counts.filter("term IS NOT NULL").join(named.select("lang", "source", "idx"), ["lang", "source"])
        lead = F.array(*[F.coalesce(F.max(F.when(F.col("idx") == k, F.col("n"))), F.lit(0)) for k in range(LEADING)])
        kept = named_counts.groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), lead.alias("lead"), F.bit_xor(F.xxhash64("idx", "n")).alias("all"))
        kept = kept.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "n_lang", "lead", "all")
        order = [F.col("lang").asc(), F.col("lead").desc(), F.col("all").asc(), F.col("term").asc()]
        vocabulary = ranks.ranked(kept, "lang", order, scratch, "terms").select(
            "lang", "term", "n_lang", F.col(ranks.POSITION).alias("pos"), F.col(ranks.MEMBERS).alias("size"))
        langs = scratch.store(vocabulary.groupBy("lang", "size").agg(F.sum("n_lang").alias("total_lang")), "langs")
        cells = scratch.store(named_counts.select("lang", "idx", "term", "n").join(vocabulary.drop("size"), ["lang", "term"]), "cells")
        totals = cells.groupBy("lang", "idx").agg(F.sum("n").alias("total"))
        zero = F.lit(0).cast("long")
        groups = named.join(totals, ["lang", "idx"], "left").join(langs, "lang", "left").select(
            "lang", "source", "idx", F.coalesce("total", zero).alias("total"), F.coalesce("size", zero).alias("size"),
            F.coalesce("total_lang", zero).alias("total_lang"))
        # What a term is worth that the group lacks; without kept terms nothing is.
        base = F.when(F.col("size") > 0, frequency(zero, F.col("total"), F.col("size")))
        self.groups = scratch.store(groups.withColumn("base", base), "groups")
        known = self.groups.select("lang", "source", "idx", "total", "size", "total_lang")
        self.cells = cells.join(known, ["lang", "idx"]).withColumns({
            "p": frequency(F.col("n"), F.col("total"), F.col("size")), "q": frequency(F.col("n_lang"), F.col("total_lang"), F.col("size"))})

    def top_terms(self, k: int = TOP_TERMS) -> DataFrame:
        """The ``k`` terms of each group that stand out most from its language: ``(lang, source, item, value, rank)``."""
        over = self.cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return over.withColumn("rank", rank).filter(F.col("rank") <= k)

    def runs(self) -> DataFrame:
        """Runs of equal values in each column, ``(lang, chunk, idx, lo, hi, p)``; what is absent is not a row here."""
        cells = self.cells.select("lang", F.floor(F.col("pos") / CHUNK).alias("chunk"), "idx", "pos", "p")
        # In a run of one value the position less the row number does not change.
        island = F.col("pos") - F.row_number().over(Window.partitionBy("lang", "chunk", "idx", "p").orderBy("pos"))
        return cells.withColumn("island", island).groupBy("lang", "chunk", "idx", "p", "island").agg(
            F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi")).drop("island")

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)`` of each group and each other source of its language."""
        size = F.col("size")
        # Each column is present in each chunk, also where it has no runs.
        spans = self.groups.filter("size > 0").select(
            "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / CHUNK))).alias("chunk"), "idx",
            (F.col("chunk") * CHUNK).alias("lo"), F.least(size, (F.col("chunk") + 1) * CHUNK).alias("hi"), F.col("base").alias("p"),
            F.lit(True).alias("whole"))
        rows = spans.unionByName(self.runs().withColumn("whole", F.lit(False)))
        blocks = self.groups.groupBy("lang").agg(F.floor(F.max("idx") / BLOCK).alias("last"))
        mine = F.floor(F.col("idx") / BLOCK)
        met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda b: F.struct(F.least(b, mine).alias("i"), F.greatest(b, mine).alias("j")))
        dealt = rows.join(blocks, "lang").select("*", F.inline(met))
        sums = dealt.groupBy("lang", "chunk", "i", "j").applyInArrow(
            _compare, "lang string, one long, two long, value long").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
        both = self.scratch.store(sums, "sums").select("lang", "value", F.inline(F.array(
            F.struct(F.col("one").alias("idx"), F.col("two").alias("other")), F.struct(F.col("two").alias("idx"), F.col("one").alias("other")))))
        name = self.groups.select("lang", "idx", "source")
        found = both.join(name, ["lang", "idx"]).join(name.select("lang", F.col("idx").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        bare = self.groups.filter("size = 0").select("lang", "source")
        none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
        return found.select("lang", "source", "item", "value").unionByName(none.select("lang", "source", "item", "value"))


def _compare(table: pa.Table) -> pa.Table:
    """Sums of ``f`` of all pairs of columns from two blocks (or within one), over one chunk."""
    lang, chunk, i, j = (table.column(c)[0].as_py() for c in ("lang", "chunk", "i", "j"))
    idx, lo, hi, p, whole = (table.column(c).to_numpy() for c in ("idx", "lo", "hi", "p", "whole"))
    columns = {}
    for k in np.unique(idx):
        own = idx == k
        span = own & whole
        start, end, base = lo[span][0], hi[span][0], p[span][0]
        here = own & ~whole
        order = np.argsort(lo[here])
        a, b, value = lo[here][order], hi[here][order], p[here][order]
        # Runs and the gaps between them: boundaries ascend, and a gap holds the value of absent terms.
        bounds = np.concatenate([[start], np.stack([a, b], axis=1).ravel()])
        values = np.concatenate([[base], np.stack([value, np.full(len(b), base)], axis=1).ravel()])
        lengths = np.diff(np.append(bounds, end))
        columns[int(k)] = bounds[lengths > 0], values[lengths > 0], end
    one, two, sums = [], [], []
    for x in columns:
        for y in columns:
            if not (x < y and x // BLOCK == i and y // BLOCK == j):
                continue
            (bx, vx, end), (by, vy, _) = columns[x], columns[y]
            cut = np.union1d(bx, by)
            times = np.diff(np.append(cut, end))
            u, v = vx[np.searchsorted(bx, cut, "right") - 1], vy[np.searchsorted(by, cut, "right") - 1]
            one.append(x)
            two.append(y)
            sums.append(int(((u - v) ** 2 // (u + v) * times).sum()))
    n = len(one)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()),
                     "value": pa.array(sums, pa.int64())})


def divergence_table(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources, and the terms that mark a group, by value."""
    columns = Columns(docs, Scratch(docs.sparkSession, "divergence"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = columns.pairs().withColumns({"rank": rank, "part": F.lit("pair")})
    return pairs.select(names).unionByName(columns.top_terms().withColumn("part", F.lit("term")).select(names))


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS size FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) t USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.size)::HUGEINT AS p,
    1 + {SCALE}::HUGEINT * (k.n + 2) // (l.total + 2 * l.size)::HUGEINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM dense x JOIN dense y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
