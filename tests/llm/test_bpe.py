import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus
from feedlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: i for i, k in enumerate(ours.entries)}, special_tokens={})


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_perfect_hash_is_minimal_and_exact(ours):
    assert sorted(ours.whole.key_at.tolist()) == list(range(len(ours.entries)))
    assert ours.whole.probe(ours.entries) == list(range(len(ours.entries)))
    assert bpe.PerfectHash([]).probe([b"x"]) == [-1]


def test_random_texts(ours, theirs):
    rnd = random.Random(2)
    letters = [chr(c) for c in [*range(1, 0x600), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640)]] + list(" \n\t'sdlmrvt0123456789") * 20
    for _ in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        raw = ours.encode(text)
        assert ids(raw) == theirs.encode_ordinary(text)
        assert ours.decode(raw) == text.encode()


def test_long_pieces_and_forgetting(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for text in ("a" * 5000, "ab" * 3000, "ñandú " * 500, "x1y2" * 700, "<|endoftext|>"):
        assert ids(ours.encode(text)) == theirs.encode_ordinary(text)


def test_tables(spark, ours, theirs):
    shared = bpe.load(spark, PATH, public_tokenizers.PATTERN)
    docs = spark.createDataFrame(corpus.ODD + corpus.generated(30), corpus.SCHEMA)
    want = []
    for r in docs.collect():
        own = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(own), hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.token_digests(docs, shared).collect()), key=str) == sorted(want, key=str)
    df, _ = corpus.clashing(spark)
    out = bpe.encode_table(df, shared)
    assert set(df.columns) - {"text"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    back = sorted(map(tuple, bpe.decode_table(out, shared).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    assert bpe.token_digests(docs.filter(F.lit(False)), shared).count() == 0
