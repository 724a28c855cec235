"""Classifiers: held-out accuracy, planted passages, and defined results for awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus
from feedlake.llm import quality_model, toxicity

LABELS = "doc_id long, quality int, toxic int"


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def rows():
    """Texts with shouted junk (bad) and with insults (toxic), the latter also in copies."""
    rnd = random.Random(8)
    lexicon = [f"{a}{b}" for a in ("tor", "mel", "san", "qui", "pra") for b in ("den", "lo", "mi", "rus", "ten", "va", "zo")]
    out, labels = [], []
    for i in range(600):
        words = [rnd.choice(lexicon) for _ in range(rnd.randint(20, 120))]
        bad, toxic = int(rnd.random() < 0.2), int(rnd.random() < 0.2)
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["blorg", "snark", "Grunk!"]))
        out.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1 - bad, toxic))
    return out, labels


@pytest.mark.parametrize(("run", "column"), [(quality_model.quality_table, 1), (toxicity.toxicity_table, 2)])
def test_held_out_accuracy(spark, rows, run, column):
    docs = spark.createDataFrame(rows[0] + [(None, "x", None, None, None), (9000, None, None, None, None)], corpus.SCHEMA)
    labels = spark.createDataFrame(rows[1] + [(None, 1, 1), (5000, 0, 1), (3, None, None)], LABELS)
    got = {r.doc_id: r for r in run(docs, labels).collect()}
    assert set(got) == {r[0] for r in rows[0]} | {None, 9000}
    assert all(r.held_out == is_held(i) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[x[0]].predicted, x[column]) for x in rows[1] if is_held(x[0])]
    assert np.mean([p == y for p, y in held]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark, rows):
    docs = spark.createDataFrame(rows[0][:200], corpus.SCHEMA)
    turned = [(i, 1 - q, 1 - t) if is_held(i) else (i, q, t) for i, q, t in rows[1][:200]]
    for run in (quality_model.quality_table, toxicity.toxicity_table):
        a, b = ({r.doc_id: round(r.score, 9) for r in run(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (rows[1][:200], turned))
        assert a == b


@pytest.mark.parametrize("run", [quality_model.quality_table, toxicity.toxicity_table])
def test_odd_rows_and_missing_labels(spark, run):
    docs, _ = corpus.clashing(spark)
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(1, 0, 1), (2, 1, 0), (4, 1, 0), (5, 0, 1)]):
        got = run(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == len(corpus.ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert run(docs.filter(F.lit(False)), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_segments_equal_brute_force():
    """Maximal scoring segments: each holds the best stretch of what the better ones leave over, and none can be extended."""
    rnd = random.Random(3)
    for _ in range(300):
        n, drift = rnd.randint(0, 14), rnd.choice([0.3, 1.0])
        scores = [rnd.choice([0, 0, 0, 0.5, 1.25, 2.5]) for _ in range(n)]
        values = [s or -drift for s in scores]

        def best(lo, hi, values=values):
            found = [(sum(values[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(found, default=(0,))
            if top[0] <= 1e-12:
                return []
            a, b = top[3:]
            return best(lo, a) + [(a, b - 1, round(top[0], 9))] + best(b, hi)

        got = [(a, b, round(s, 9)) for a, b, s in toxicity.segments([(i, s) for i, s in enumerate(scores) if s], drift)]
        assert got == best(0, n)


def test_passages_are_the_planted_ones(spark, rows):
    docs, labels = spark.createDataFrame(rows[0], corpus.SCHEMA), spark.createDataFrame(rows[1], LABELS)
    found = {r.doc_id for r in toxicity.passage_table(docs, labels).collect()}
    assert found == {i for i, _, t in rows[1] if t}


def test_flat_trees_walk_like_nested_conditions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, quality_model.N_FEATURES))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.4)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for row in x[:20]:
        z = model.start
        for t in range(len(model.leaf)):
            at = 0
            while at < 2 ** quality_model.DEPTH - 1:
                at = 2 * at + (2 if row[model.feature[t, at]] > model.limit[t, at] else 1)
            z += model.leaf[t, at - (2 ** quality_model.DEPTH - 1)]
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-z))) < 1e-12
