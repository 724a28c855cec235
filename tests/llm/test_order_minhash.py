"""Order MinHash against a plain Python selection from the whole text, and what its likeness says about edits."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from corpus import SCHEMA, clashing, generated, odd
from pyspark.sql import functions as F

from feedlake.llm import order_minhash as O

TOKEN = re.compile(O.TOKEN)
MASK = (1 << 64) - 1


def spark_hash(*values):
    """The hash of columns: each value with the hash before it as seed."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, Long) else "<i", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class Long(int):
    pass


def signed(x):
    return Long(x - (1 << 64) if x >> 63 else x)


def fingerprint(text):
    tokens = TOKEN.findall(text)
    kmers = [spark_hash(*tokens[i:i + 2]) >> 27 << 27 for i in range(max(len(tokens) - 1, min(1, len(tokens))))]
    seen, numbered = {}, []
    for at, x in enumerate(kmers):
        k = seen[x] = seen.get(x, -1) + 1
        numbered.append((spark_hash(signed(x), k) >> 27, at))
    out = []
    for g in range(O.CLASSES):
        for j in range(O.TUPLES // O.CLASSES):
            best = []
            for half in (0, 1):
                ranked = []
                for x, at in numbered:
                    h = spark_hash(Long(signed(x << 27) // (1 << 27)), j)
                    value = h >> 32 if half == 0 else h & 0xFFFFFFFF
                    if len(kmers) <= O.FEW or x % O.CLASSES == g:
                        ranked.append((x % O.CLASSES != g, value, at))
                best.append(min(ranked, default=None))
            if None in best:
                out.append("0" * 8)
                continue
            (la, va, pa), (lb, vb, pb) = best
            order = (pa > pb) - (pa < pb)
            out.append(f"{spark_hash(Long(va + (la << 32)), Long(vb + (lb << 32)), order) & 0xFFFFFFFF:08x}")
    return "".join(out)


def same(a, b):
    return sum(a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)) / O.TUPLES


def brute(rows):
    docs = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, signed(spark_hash(r["text"] or "")), r["doc_id"], r["text"] or "") for r in rows), key=lambda x: x[:3])
    out = []
    for k, (*_, doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][-1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(following)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, same(a, b), same(a, c)))
    return sorted(out, key=str)


def table(df):
    return sorted([tuple(r) for r in O.edited_table(df).collect()], key=str)


def test_equals_plain_selection(spark, monkeypatch):
    monkeypatch.setattr(O, "CELL_ROWS", 9)
    df = spark.createDataFrame(generated(80), SCHEMA).repartition(5)
    got = table(df)
    assert got == brute(df.collect())
    by_print = {}
    for r in got:
        by_print.setdefault(r[3], set()).add(r[0])
    assert any(len(v) > 1 for v in by_print.values())


@pytest.mark.parametrize("cell_rows", [2, 1000])
def test_awkward_rows(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(O, "CELL_ROWS", cell_rows)
    want = brute(odd(spark).collect())
    assert table(odd(spark)) == want
    df, names = clashing(spark)
    for name in ("cell", "ghost", "at", "h", "_code", "_side", "fingerprint", "edited", "next_text"):
        df = df.withColumn(name, F.lit("x"))
    assert table(df) == want


def test_one_row_and_none(spark):
    one = [(5, "a single text of some words", "en", "s", 0)]
    df = spark.createDataFrame(one, SCHEMA)
    assert table(df) == brute(df.collect())
    assert table(spark.createDataFrame([], SCHEMA)) == []


def test_hot_id_is_cut(spark, monkeypatch):
    """A third of the rows with one id spread over cells and keep their order."""
    monkeypatch.setattr(O, "CELL_ROWS", 10)
    rows = [(7 if i % 3 == 0 else i, f"text number {i} of the hot id", "en", "s", 0) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert table(df) == brute(df.collect())
    from feedlake.llm.common import Scratch
    cells = O.with_next(df, Scratch(spark, "test")).filter("NOT ghost AND doc_id = 7").select("cell").distinct().count()
    assert cells > 2


def test_likeness_follows_edits_and_order(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
    few = [w if rnd.random() > 0.03 else "edit" for w in words]
    many = [w if rnd.random() > 0.3 else "edit" for w in words]
    moved = words[300:] + words[:300]
    texts = [(0, words), (1, few), (2, many), (3, moved), (4, [f"v{i}" for i in range(600)])]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts], "id long, text string")
    got = {r.id: r.fp for r in O.signatures(df, ["id"], {"fp": F.col("text")}).collect()}
    like = [same(got[0], got[k]) for k in range(5)]
    assert like[0] == 1 and like[0] > like[1] > like[2] > like[4] == 0
    assert 0.3 < like[3] < 0.7


def test_plan_is_native_with_one_shuffle_of_texts(spark):
    df = spark.createDataFrame(generated(20), SCHEMA)
    plan = O.edited_table(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 2
