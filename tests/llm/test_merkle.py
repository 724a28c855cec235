"""Merkle manifest against a tree built level by level in plain Python."""

import hashlib
import zlib

import pytest
from corpus import SCHEMA, clashing, generated, odd
from pyspark.sql import functions as F

from feedlake.llm import merkle
from feedlake.llm.common import Scratch


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, extra=0):
    n = row["n_chars"]
    values = [row["doc_id"], row["source"], row["lang"], None if n is None else n + extra, row["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        other = pos ^ 1
        out.append(("" if other > pos or other >= len(level) else level[other], level[other] if pos < other < len(level) else ""))
        pos //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    upper = tree([trees[x][-1][0] for x in names])
    out = []
    for k, name in enumerate(names):
        for pos, r in enumerate(groups[name]):
            path = siblings(trees[name], pos) + siblings(upper, k)
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf(r, int(changed))
            for before, after in path:
                folded = h(before, folded, after)
            out.append((r["doc_id"], leaf(r), trees[name][-1][0], upper[-1][0], h(*[a + b for a, b in path]), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def report(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in merkle.tamper_report(df).collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 129, 700])
def test_sizes(spark, n):
    rows = [(i * 3, f"text {i}", "en" if i % 5 else "de", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert report(df) == brute(df.collect())


def test_awkward_rows_and_clashing_columns(spark):
    want = brute(odd(spark).collect())
    assert report(odd(spark)) == want
    df, names = clashing(spark)
    for name in ("grp", "rank", "leaf", "name", "pos", "path", "levels"):
        df = df.withColumn(name, F.lit("x"))
    assert report(df) == want


def test_many_groups_one_hot(spark):
    rows = [(i, t, f"lang{i}" if i % 3 else None, s, n) for i, t, _, s, n in generated(200)] + [(7, "same", None, "s", 4)] * 90
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = report(df)
    assert got == brute(df.collect())
    assert {v for *_, v in got} == {True, False}


def test_empty_table(spark):
    assert merkle.tamper_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nodes_cover_their_intervals(spark):
    rows = [(i, str(i), "en", "s", i) for i in range(150)]
    manifest = merkle.build_manifest(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test"))
    nodes = manifest.nodes().collect()
    assert len(nodes) == 150 + 75 + 38 + 19 + 10 + 5 + 3 + 2 + 1
    for r in nodes:
        assert r.lo % (1 << r.level) == 0 and r.hi == min(150, r.lo + (1 << r.level))
    by_label = {(r.level, r.lo): r.digest for r in nodes}
    for r in nodes:
        if r.level:
            below = [by_label.get((r.level - 1, lo), "") for lo in (r.lo, r.lo + (1 << r.level - 1))]
            assert r.digest == h(*below)
