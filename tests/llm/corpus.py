"""Small corpora for the tests: awkward rows, and generated texts with copies, edits and shared passages."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null in every column, empty and blank texts, one word, ties, repeated rows, characters outside ASCII, a long text.
ODD = [
    (1, None, None, None, None), (None, "nobody knows this id", "en", "s", 20), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4),
    (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (6, "repeated row", "en", "s", 12), (6, "repeated row", "en", "s", 12),
    (7, "É ß ñandú \x1c sep\x85arators   and 漢字 🙂 " * 12, "es", "t", 400), (8, "word " * 40_000, "en", "t", 200_000),
    (None, None, None, None, None), (9, "\n\n\n", "en", "s", 3), (10, "a" * 5000, "de", "t", 5000),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clashing(spark, rows=None):
    """The same rows with extra columns, named like the ones that operators add."""
    names = ["_derived", "score", "fp", "votes", "n_tokens", "token_ids", "k1", "cores", "path", "_rank"]
    df = spark.createDataFrame(rows or ODD, SCHEMA)
    for n in names:
        df = df.withColumn(n, df.doc_id)
    return df, names


def generated(n: int = 120, seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    lexicon = ["".join(rnd.choice("abcdefghéñß") for _ in range(rnd.randint(2, 9))) for _ in range(600)]

    def prose(k: int) -> list[str]:
        return [rnd.choice(lexicon[:40] if rnd.random() < 0.4 else lexicon) for _ in range(k)]

    passage = " ".join(prose(70))
    rows, texts = [], []
    for i in range(n):
        kind = i % 6
        if kind == 0 and texts:
            text = rnd.choice(texts)
        elif kind == 1 and texts:
            words = rnd.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[rnd.randrange(len(words))] = rnd.choice(lexicon)
            text = " ".join(words)
        elif kind == 2:
            text = " ".join(prose(rnd.randint(5, 60))) + "\n" + passage + "\n" + " ".join(prose(20))
        else:
            text = " ".join(prose(rnd.randint(3, 300)))
        texts.append(text)
        rows.append((i, text, rnd.choice(["en", "de"]), f"src{0 if i % 3 == 0 else i % 7}", len(text)))
    return rows
