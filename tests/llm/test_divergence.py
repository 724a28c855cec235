"""Divergence of sources against a dense computation in plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from corpus import SCHEMA, clashing, generated, odd
from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value
from pyspark.sql import functions as F

from feedlake.llm import divergence
from feedlake.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def f(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows):
    docs = [(r["lang"] or "", r["source"] or "", WORD.findall((r["text"] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        seen, count = Counter(), defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                seen.update(set(words))
                count[source].update(words)
        kept = sorted(w for w, k in seen.items() if k >= 10)
        size = len(kept)
        whole = Counter()
        for c in count.values():
            whole.update(c)

        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * size) for w in kept}

        p = {s: share(c) for s, c in count.items()}
        q = share(whole)
        for s in count:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in count if t != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)]
    return sorted(out)


def table(df):
    return sorted(tuple(r) for r in divergence.divergence_table(df).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(spark):
    return spark.createDataFrame([(i, t.replace(" ", " ABC-é "), lang, s, n) for i, t, lang, s, n in generated(240)], SCHEMA)


def test_equals_dense_computation(spark):
    df = corpus(spark)
    got = table(df)
    assert got == brute(df.collect())
    assert {r[2] for r in got} == {"pair", "term"}


def test_chunks_and_blocks(spark, monkeypatch):
    """Small chunks and blocks give the same sums, also for columns that are absent from whole chunks."""
    want = brute(corpus(spark).collect())
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    # The compared function runs in other processes: the block size travels with it.
    register_pickle_by_value(divergence)
    try:
        assert table(corpus(spark)) == want
    finally:
        unregister_pickle_by_value(divergence)


def test_awkward_rows(spark):
    assert table(odd(spark)) == brute(odd(spark).collect())
    rows = [(i, "a b C", None if i % 2 else "en", None if i % 3 else "x", 5) for i in range(60)] + [(1, None, "zz", "a", 0), (1, " 1 2", "zz", "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = table(df)
    assert got == brute(df.collect())
    assert ("zz", "a", "pair", "b", 0, 1) in got
    assert table(spark.createDataFrame([], SCHEMA)) == []


def test_clashing_columns_and_one_group(spark):
    df, names = clashing(spark, [(i, "one two Two", "en", "only", 1) for i in range(12)])
    for name in ("idx", "term", "n", "pos", "chunk", "value", "item"):
        df = df.withColumn(name, F.lit("x"))
    assert table(df) == []


def test_runs_follow_the_order_of_counts(spark):
    """Terms with equal counts stand together, so that runs are fewer than cells."""
    rows = [(i, " ".join(f"w{chr(97 + k % 20)}{chr(97 + k // 20)}" for k in range(300) if k % (1 + i % 3) == 0), "en", f"s{i % 3}", 0) for i in range(60)]
    columns = divergence.Columns(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test"))
    assert columns.runs().count() * 10 < columns.cells.count()


@pytest.mark.parametrize("text,want", [("It's A_Test é1ß", [b"it", b"s", b"a", b"test", "é".encode(), "ß".encode()]), ("", []), ("ÀB漢", ["Àb漢".encode()])])
def test_terms(text, want):
    assert divergence.terms(text) == want
