from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus
from feedlake.llm import quality_rules as q


def brute_counts(text):
    seps = set(" \t\n\x0b\x0c\r")
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in seps:
            if word:
                words.append(word)
            word = ""
        else:
            word += ch
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in seps for c in x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("make", [corpus.odd, lambda s: s.createDataFrame(corpus.generated(), corpus.SCHEMA)])
def test_counts_equal_brute_force(spark, make):
    docs = make(spark)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.rule_table(docs).collect()]
    want = []
    for r in docs.collect():
        c = brute_counts(r.text)
        want.append((r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_label_model_recovers_accuracies_of_independent_rules():
    rnd = np.random.default_rng(1)
    n, m = 20_000, len(q.RULES)
    truth = rnd.random(n) < 0.8
    accuracy = np.linspace(0.65, 0.95, m)
    right = rnd.random((n, m)) < accuracy
    silent = rnd.random((n, m)) < 0.2
    v = np.where(silent, 0, np.where(right == truth[:, None], 1, -1))
    odds, ratio = q.fit_label_model([(list(k), c) for k, c in Counter(map(tuple, v.tolist())).items()])
    z = odds + sum(ratio[i][v[:, i] + 1] for i in range(m))
    assert abs(1 / (1 + np.exp(-odds)) - 0.8) < 0.02
    # Better than counting votes.
    assert ((z > 0) == truth).mean() > ((v.sum(1) > 0) == truth).mean()


def test_votes_posterior_and_kept_rows(spark):
    rows = [(i, " ".join(f"word{j % 97} text{j * i % 89}" for j in range(60)), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, " ".join(f"w{j * (i + 1) % 83}$$$ x{j}&&&" for j in range(60)), "en", "s", 1) for i in range(8)]
    df, extra = corpus.clashing(spark, rows)
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(40))
    table = q.rule_table(df)
    assert {r.doc_id for r in table.filter("kept").collect()} == set(range(40))
    model = q.learn(table, "votes")
    vote = table.select("votes", "quality").first()
    z = model[0] + sum(model[1][i][v + 1] for i, v in enumerate(vote.votes))
    assert abs(vote.quality - 1 / (1 + np.exp(-z))) < 1e-6


def test_empty_table(spark):
    empty = corpus.odd(spark).filter(F.lit(False))
    assert q.rule_table(empty).count() == 0
    assert q.keep_good(empty).columns == empty.columns
