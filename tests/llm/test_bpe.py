import hashlib
import random

import public_tokenizers as tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_as_tiktoken(spark, oracle):
    rng = random.Random(3)
    texts = [None, "", " ", "a" * 5000, "<|endoftext|>", " \n\n\t x", "don't WE'LL 12345 ünï \U0001f600 \x1c\x85"]
    texts += ["".join(rng.choice("ab \n'sré1٣theing") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, None, "x"), (None, "twice", "y"), (None, "twice", "y")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, tokenizers.PATTERN)
    want = sorted((str(i), oracle.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    digest = {r.doc_id: r for r in bpe.digests(got.where("doc_id = 6")).collect()}[6]
    ids = oracle.encode_ordinary(texts[6])
    assert digest.n_tokens == len(ids) and digest.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest.decoded_sha256 == hashlib.sha256(texts[6].encode()).hexdigest()


def test_decode_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, PATH, tokenizers.PATTERN).count() == 0
    some = bpe.encode(spark.createDataFrame([(1, "Straße 9")], "doc_id long, text string"), PATH, tokenizers.PATTERN)
    assert bytes(bpe.decode(some, PATH).first().decoded_bytes).decode() == "Straße 9"


def test_lower_rank_that_comes_up_goes_first():
    """Ranks that no training would give: after a merge a lower rank appears in the same word."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 900, b"abc": 300, b"ca": 950}
    oracle = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    replay, rng = bpe.MergeReplay(ranks), random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    assert [list(x) for x in replay.encode([w.encode() for w in words])] == [oracle.encode_ordinary(w) for w in words]
