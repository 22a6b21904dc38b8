"""Texts of megabytes, beside null and empty ones, through operators that read a text whole."""

import hashlib
import random

import public_tokenizers as tokenizers
import tiktoken

from tidemark.llm import bpe, quality_classifier as Q, secrets as S, warc
from tidemark.llm.common import shared_dir


def long_text(words=400_000, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "Mountain", "größe", "12345", "letter.", "\n", "x" * 20]) for _ in range(words))


def test_tokens_of_a_long_text(spark):
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    oracle = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    text = long_text(200_000)
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), path, tokenizers.PATTERN).collect()}
    assert list(got[1].ids) == oracle.encode_ordinary(text) and bytes(got[1].decoded) == text.encode() and list(got[2].ids) == list(got[3].ids) == []


def test_secrets_at_both_ends_of_a_long_text(spark):
    text = "password=hunter2hunter2 " + long_text() + " AKIA" + "Z" * 16
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.scan(docs).collect()}
    assert got[1][0] == ("assign", 0, 23) and got[1][-1] == ("access", len(text) - 20, len(text)) and got[2] == got[3] == []
    clean = {r.doc_id: r.text for r in S.redact(docs).collect()}
    assert clean[1].startswith("[SECRET] ") and clean[1].endswith(" [SECRET]") and clean[2] is None and clean[3] == ""


def test_records_of_long_payloads(spark):
    html = long_text(300_000)
    rows = [(1, "http://a/1", html, "f"), (2, "http://a/2", html, "f"), (3, "http://a/3", None, "f"), (4, "http://a/4", "", "f")]
    path = f"{shared_dir(spark)}/warc-long"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, file string"), path)
    got = {r.page_id: tuple(r)[1:] for r in warc.pages_of(warc.read(spark, path)).collect()}
    data, none = html.encode(), hashlib.sha1(b"").hexdigest()
    digest = hashlib.sha1(data).hexdigest()
    assert got == {1: (len(data), digest, "revisit", 2), 2: (len(data), digest, "response", None), 3: (0, none, "response", None), 4: (0, none, "response", None)}


def test_quality_of_a_long_text(spark):
    rng = random.Random(2)
    good, bad = "river mountain letter house", "zzz qqq xxx !!!"
    rows = [(i, " ".join(rng.choices((good if i % 2 else bad).split(), k=30)), "s", "en") for i in range(200)] + [(900, " ".join(rng.choices(good.split(), k=300_000)), "s", "en"), (901, None, "s", "en"), (902, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == 203 and got[900].p_quality > 0.5 > got[900].p_toxic and abs(got[901].p_quality - got[902].p_quality) <= 1
