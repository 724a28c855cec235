import random

import corpus
from feedlake.llm import simhash


def brute_sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(rows):
    """The smallest ids of the components of pairs with Jaccard 0.8 or more."""
    sets, group = [brute_sets(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted({min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group})


def edited(seed):
    """Texts with edits on both sides of 0.8, chains of edits, cuts, and a passage that all share."""
    rnd = random.Random(seed)
    lexicon = [f"w{i}" for i in range(4000)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for _ in range(12):
        words = [rnd.choice(lexicon) for _ in range(rnd.randint(20, 200))] + passage
        for step in range(8):
            rows.append((len(rows), " ".join(words), "en", "s", 0))
            words = list(words)
            for _ in range(max(1, len(words) * step // 180)):
                words[rnd.randrange(len(words))] = rnd.choice(lexicon)
            if step == 5:
                words = words[:len(words) * 9 // 10]
    return rows


def test_kept_rows_equal_brute_force(spark):
    for rows in (edited(1), edited(2), corpus.generated()):
        got = sorted(r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, corpus.SCHEMA)).collect())
        assert got == brute_kept(rows)
        assert len(got) < len(rows)


def group_of(n, seed=7):
    """One text of 300 words in ``n`` versions, each with two words replaced: near most others."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(2):
            words[rnd.randrange(len(words))] = f"e{i}x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def test_links_of_a_large_group_stay_linear(spark, monkeypatch):
    from feedlake.llm import near_copies
    from feedlake.llm.common import Scratch
    sizes = []
    inner = near_copies.connected_components

    def counted(links, scratch, name):
        sizes.append(links.count())
        return inner(links, scratch, name)

    monkeypatch.setattr(near_copies, "connected_components", counted)
    df = spark.createDataFrame(group_of(2000), corpus.SCHEMA).repartition(8)
    groups = near_copies.near_groups(df, Scratch(spark, "test")).collect()
    assert len(groups) == 2000 and len({r.label for r in groups}) == 1
    assert max(sizes) < 20_000


def test_null_repeated_and_no_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, None, None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "A b", "en", "s", 3)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, corpus.SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    assert simhash.keep_one_of_each(spark.createDataFrame([], corpus.SCHEMA)).collect() == []


def test_fingerprints_propose_pairs_of_sets(spark, monkeypatch):
    from feedlake.llm import near_copies
    proposed = {}
    inner, verified = simhash.near_links, near_copies._verified

    def linked(fps):
        proposed["fingerprints"] = fps.count()
        return inner(fps)

    def counted(pairs, docs, ids, scratch, name):
        out = verified(pairs, docs, ids, scratch, name)
        proposed[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "near_links", linked)
    monkeypatch.setattr(near_copies, "_verified", counted)
    rows = group_of(60) + edited(3)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = sorted(r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, corpus.SCHEMA)).collect())
    assert got == brute_kept(rows)
    # Found by fingerprints and confirmed; the prefixes find the others.
    assert proposed["fingerprints"] > 60 and 0 < proposed["proposed"] < len(rows)
    assert proposed["star-0"] > 0
