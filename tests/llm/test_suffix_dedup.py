import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus
from feedlake.llm import suffix_dedup as s


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = s.LENGTH
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    got = s.remove_repeats(docs).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)


def expected(rows):
    return sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)), key=str)


def test_generated_and_odd_rows(spark):
    rows = corpus.generated(90) + [(1000 + (i or 0), *r) for i, *r in corpus.ODD if r[0] is None or len(r[0]) < 20_000] + [(None, "x" * 300, None, None, None)]
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_the_edge_of_the_threshold(spark, seed):
    """Strings of 198 to 260 bytes shared by a few texts in different surroundings, periodic texts, repeats within a text."""
    rnd = random.Random(seed)
    noise = lambda k: "".join(rnd.choice("abcd ") for _ in range(k))
    shared = [noise(k) for k in (198, 199, 200, 201, 213, 260, 500)]
    rows = []
    for i in range(60):
        parts = [noise(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(shared)
            a = rnd.choice([0, 0, 1, 7])
            parts += [own[a:len(own) - rnd.choice([0, 0, 1, 30])], noise(rnd.randint(0, 120))]
        rows.append((i, "".join(parts), "en", "s", 1))
    rows += [(100, "ab" * 300, "en", "s", 1), (101, "xyz" * 150 + noise(50), "en", "s", 1), (102, "ñ" * 201, "en", "s", 1), (103, "q" * 200, "en", "s", 1), (104, "q" * 199, "en", "s", 1)]
    assert run(spark, rows) == expected(rows)


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(s, "PART", 64)
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdef") for _ in range(1200))
    rows = [(1, base[:700] + "Z" + base[700:], "en", "s", 1), (2, base[300:1000], "en", "s", 1), (3, base[650:860], "en", "s", 1)]
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert s.remove_repeats(corpus.odd(spark).filter(F.lit(False))).count() == 0
