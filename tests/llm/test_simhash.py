import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus
from feedlake.llm import components, simhash
from feedlake.llm.common import Scratch


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, fps, strict=True):
        least[g].append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in least.items()}
    return sorted(((i, f"{fp:016x}", low[g]) for g, (i, fp) in zip(group, fps, strict=True)), key=str)


@pytest.mark.parametrize("make", [corpus.odd, lambda s: s.createDataFrame(corpus.generated(), corpus.SCHEMA)])
def test_components_equal_brute_force(spark, make):
    docs = make(spark)
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_links_miss_no_pair(spark):
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values):
        for k in range(1, 5):
            for _ in range(4):
                x = v
                for b in rnd.sample(range(64), k):
                    x ^= 1 << b
                values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_every_value_has_one_home_anchor_within_one_bit(spark):
    df = spark.range(4000).select((F.col("id") * 1_073_807).bitwiseAND(F.lit(0xFFFFFFFF)).alias("x"))
    rows = df.select("x", simhash.home_anchor(F.col("x")).alias("h"), simhash.near_anchors(F.col("x")).alias("n")).collect()
    for r in rows:
        assert (r.x ^ r.h).bit_count() <= 1 and r.h in r.n
        assert len(set(r.n)) == len(r.n) and max((r.x ^ a).bit_count() for a in r.n) <= 2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 6), (6, 5), (3, 3)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {7}
    assert got[6] == got[5] == 5 and got[3] == 3


def test_one_of_each_stays(spark):
    df, _ = corpus.clashing(spark)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    groups = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({c for _, c in groups}, key=str)
    assert simhash.keep_one_of_each(df.filter(F.lit(False))).count() == 0
