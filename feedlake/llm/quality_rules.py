"""Weak supervision of document quality: rules vote or abstain, expectation-maximisation weighs them.

Each rule reads a few statistics of a text and votes good (1), bad (-1) or abstains (0). How far each vote can be trusted
is estimated without labels: a two-class model with votes independent given the class is fitted by
expectation-maximisation on the counts of vote patterns. There are at most ``3 ** len(RULES)`` patterns whatever the
size of the corpus, so the counts of all documents fit a driver. A document is kept if its posterior probability of
being good is at least one half and the two hard limits of ``base_failed`` hold.

Null and empty texts have no words: every count is 0 and ``base_failed`` is true. Repeated rows are judged each for
itself. An empty table fits no model and gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch, text_function, with_text

SEPARATORS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
         "n_lines": "long", "n_upper_words": "long", "n_marked_words": "long", "n_letters": "long", "n_distinct": "long"}

#: Rule, value, and the bounds: at or below the first the vote is good, at or above the second it is bad, between abstain.
RULES: list[tuple[str, float, float]] = [
    ("symbols_per_word", 0.05, 0.20),
    ("upper_share", 0.15, 0.40),
    ("marked_share", 0.05, 0.25),
    ("repeat_share", 0.15, 0.50),
    ("same_word_share", 0.70, 0.90),
    ("dup_line_share", 0.20, 0.60),
    ("other_char_share", 0.20, 0.40),
    ("word_length_off", 3.0, 7.0),
]
TYPICAL_WORD_LENGTH = 5.5


def _stats(texts: list[str]) -> Iterator[tuple]:
    for text in texts:
        words = text.encode().split()
        n = len(words)
        repeat = 0
        if n >= 3:
            windows = list(zip(words, words[1:], words[2:], strict=False))
            if len(set(windows)) < len(windows):
                seen: dict = {}
                covered = np.zeros(n, dtype=bool)
                for i, w in enumerate(windows):
                    first = seen.setdefault(w, i)
                    if first != i:
                        covered[i:i + 3] = True
                        covered[first:first + 3] = True
                repeat = int(covered.sum())
        lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
        kinds = set(words)
        upper = [w.decode() for w in words if w[:1].isupper() or w[0] > 127]
        yield (n, len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
               len(lines), sum(len(w) > 1 and w.isupper() for w in upper),
               sum(w[-1] in b"#*$%&|<>!" for w in words), sum(map(str.isalpha, text)), len(kinds))


rule_stats = text_function(_stats, STATS)


def votes(stats: Column) -> Column:
    """Array of the votes of ``RULES``; a text without words leaves every rule abstaining."""
    s = {k: stats[k].cast("double") for k in STATS}
    words, chars, lines = (F.greatest(s[k], F.lit(1.0)) for k in ("n_words", "word_chars", "n_lines"))
    value = {
        "symbols_per_word": s["n_symbols"] / words, "upper_share": s["n_upper_words"] / words,
        "marked_share": s["n_marked_words"] / words, "repeat_share": s["n_repeat_words"] / words,
        "same_word_share": 1 - s["n_distinct"] / words, "dup_line_share": s["n_dup_lines"] / lines,
        "other_char_share": 1 - s["n_letters"] / chars, "word_length_off": F.abs(chars / words - TYPICAL_WORD_LENGTH),
    }
    return F.array(*(
        F.when(s["n_words"] == 0, 0).when(value[k] <= good, 1).when(value[k] >= bad, -1).otherwise(0)
        for k, good, bad in RULES))


def fit_label_model(patterns: list[tuple[list[int], int]], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over ``(votes, count)``: log odds of the class, and ``[rule, vote + 1]`` log ratios.

    Starts from the share of good votes, so that the first class is the one most rules call good. One pseudo-count a
    vote keeps unseen votes finite; abstentions carry evidence, too.
    """
    if not patterns:
        return 0.0, np.zeros((len(RULES), 3))
    v = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], dtype=float)
    onehot = np.eye(3)[v]
    good = (1 + (v == 2).sum(1)) / (2 + (v == 2).sum(1) + 3 * (v == 0).sum(1))
    odds, ratio = 0.0, np.zeros((v.shape[1], 3))
    for _ in range(rounds):
        tables = []
        for share in (good, 1 - good):
            t = np.einsum("p,prk->rk", n * share, onehot) + 1
            tables.append(t / t.sum(1, keepdims=True))
        ratio = np.log(tables[0]) - np.log(tables[1])
        p = ((n * good).sum() + 1) / (n.sum() + 2)
        odds = math.log(p / (1 - p))
        z = odds + np.einsum("prk,rk->p", onehot, ratio)
        new = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        moved = np.abs(new - good).max()
        good = new
        if moved < 1e-9:
            break
    return odds, ratio


def posterior(vote: Column, model: tuple[float, np.ndarray]) -> Column:
    odds, ratio = model
    z = F.lit(float(odds))
    for i, row in enumerate(ratio):
        bad, none, good = map(float, row)
        z = z + F.when(vote[i] == 1, good).when(vote[i] == -1, bad).otherwise(none)
    return F.round(1 / (1 + F.exp(-z)), 9)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def learn(judged: DataFrame, vote: str) -> tuple[float, np.ndarray]:
    """Fit the label model to the vote patterns of all rows."""
    counts = judged.groupBy(vote).count().collect()
    return fit_label_model(sorted((list(r[0]), r[1]) for r in counts))


def rule_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, statistics, votes, posterior and verdict of every row."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    derived, name = with_text(docs.select("doc_id", "text"), rule_stats)
    stats = scratch.store(derived.select("doc_id", F.col(name).alias("s")), "stats")
    judged = stats.withColumn("votes", votes(F.col("s")))
    model = learn(judged, "votes")
    return judged.select("doc_id", "s.*", "votes", posterior(F.col("votes"), model).alias("quality"),
                         base_failed(F.col("s")).alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    derived, name = with_text(docs, rule_stats)
    model = learn(derived.select(votes(F.col(name)).alias("votes")), "votes")
    s = F.col(name)
    return derived.filter(~base_failed(s) & (posterior(votes(s), model) >= 0.5)).drop(name)
