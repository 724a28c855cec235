import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus
from feedlake.llm import decontaminate as d

ITEMS = "item_id long, text string"


def brute_overlaps(text, item):
    """Does some offset have a window that agrees in enough positions?"""
    words, own = d.tokens(text or ""), d.tokens(item or "")
    size = min(d.WINDOW, len(own))
    if not size:
        return False
    for offset in range(-len(own), len(words)):
        agree = [0 <= i + offset < len(words) and words[i + offset] == w for i, w in enumerate(own)]
        for i in range(len(own) - size + 1):
            if 0 <= i + offset and i + offset + size <= len(words) and sum(agree[i:i + size]) >= d.needed(size):
                return True
    return False


def test_masks_are_lossless():
    """Whatever positions are substituted within the tolerance, some mask lies on agreeing positions."""
    for size in range(min(map(len, d.MASKS)), d.WINDOW + 1):
        places = [sum(1 << p + i for i, c in enumerate(m) if c == "1") for m in d.MASKS for p in range(size - len(m) + 1)]
        for missed in itertools.combinations(range(size), size - d.needed(size)):
            x = sum(1 << i for i in missed)
            assert any(not x & p for p in places), (size, missed)


@pytest.mark.parametrize("block", [d.BLOCK_TOKENS, 60])
def test_overlaps_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_TOKENS", block)
    rnd = random.Random(5)
    lexicon = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(lexicon) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 7, 8, 10, 15, 20, 25, 40, 40])]
    items += [(None, None), (50, ""), (51, "..."), (9, items[9][1])]
    rows = []
    for i in range(90):
        words = [rnd.choice(lexicon) for _ in range(rnd.randint(0, 60))]
        _, source = rnd.choice(items[:12])
        cut = source.split()
        for _ in range(round(len(cut) * rnd.choice([0, 0.1, 0.2, 0.3]))):
            cut[rnd.randrange(len(cut))] = rnd.choice(lexicon)
        at = rnd.randint(0, len(words))
        words[at:at] = cut[rnd.choice([0, 0, 3]):]
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(words).title(), "en", "s", 1))
    rows += corpus.ODD
    docs, bench = spark.createDataFrame(rows, corpus.SCHEMA), spark.createDataFrame(items, ITEMS)
    got = sorted(((r.doc_id, r.item_id) for r in d.overlap_table(docs, bench).collect()), key=str)
    want = sorted(((r[0], k) for r in rows for k, t in items if brute_overlaps(r[1], t)), key=str)
    assert got == want and len(want) > 40
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = [r[0] for r in rows if not any(brute_overlaps(r[1], t) for _, t in items)]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_place_and_counts(spark):
    item = " ".join(f"t{i}" for i in range(30))
    words = item.split()
    words[4] = words[17] = "other"
    docs = spark.createDataFrame([(1, "a b c " + " ".join(words) + " z", "en", "s", 1)], corpus.SCHEMA)
    got = d.overlap_table(docs, spark.createDataFrame([(8, item)], ITEMS)).collect()
    assert [tuple(r) for r in got] == [(1, 8, 3, 30, 28)]


def test_empty_tables(spark):
    docs, _ = corpus.clashing(spark)
    bench = spark.createDataFrame([], ITEMS)
    assert d.overlap_table(docs, bench).collect() == []
    assert d.drop_contaminated(docs, bench).count() == docs.count()
    assert d.overlap_table(docs.filter(F.lit(False)), spark.createDataFrame([(1, "one")], ITEMS)).collect() == []
