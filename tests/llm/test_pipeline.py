"""The pipeline, stage by stage and as a whole, against plain Python on a small table."""

import random

import corpus_pipeline as C
import pandas as pd
import pytest
from tests.llm.test_decontaminate import distance
from tests.llm.test_ngram_join import brute_sets
from tests.llm.test_quality_rules import brute as counts
from tidemark.llm import decontaminate, secrets

COMMON = "the of and to in a is that for it".split()
ITEM = "which of the old mills by the river was the first to close in winter"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def prose(rng, n=90):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choice("abcdeilmnorst") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = [(i, prose(rng)) for i in range(30)]
    t = dict(texts)
    texts += [(40, t[3]), (41, t[3] + " end"), (1, t[3] + " one more"), (7, t[7]), (7, t[7]), (None, t[8]), (None, t[8]), (None, prose(rng)), (9, prose(rng))]
    texts += [(50, prose(rng) + " " + ITEM + " " + prose(rng)), (None, ITEM.upper() + " " + prose(rng)), (51, prose(rng) + " " + ITEM.replace("winter", "winters") + " and"), (52, prose(rng) + " password = hunter2hunter2 " + prose(rng))]
    texts += [(60, None), (61, ""), (62, "too short"), (63, "again and again " * 40), (64, prose(rng, 20_000)), (65, " ".join(w + "***" for w in prose(rng).upper().split()))]
    return [(i, x, "en", "web", len(x or ""), "clash") for i, x in texts]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def listed(df):
    return sorted(map(str, map(tuple, df.collect())))


def after_duplicates(rows):
    sets, left = brute_sets([r[1] for r in rows]), list(range(len(rows)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i in sorted(left, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        first.setdefault(find(i) if sets[i] else ("alone", i), i)
    return [rows[i] for i in sorted(first.values())]


def contaminated(text):
    item = decontaminate.normal(ITEM)
    return distance(item, decontaminate.normal(text)) <= int(decontaminate.ERROR_RATE * len(item))


def test_stages(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = C.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    good = [r for r in rows if r[0] not in (60, 61, 62, 63, 65)]
    assert listed(kept) == sorted(map(str, good)) and not any(counts(r[1])[-1] for r in good)
    once = C.near_duplicates(spark, spark.createDataFrame(good, SCHEMA), folder)
    want = after_duplicates(good)
    assert once.columns == docs.columns and listed(once) == sorted(map(str, want)) and len(good) - len(want) == 7
    clean = C.benchmark(spark, spark.createDataFrame(want, SCHEMA), folder)
    left = [r for r in want if r[0] == 64 or not contaminated(r[1])]
    assert clean.columns == docs.columns and listed(clean) == sorted(map(str, left)) and len(want) - len(left) == 3
    hidden = C.secret_spans(spark, spark.createDataFrame(left, SCHEMA), folder)
    scanner = secrets.TrigramScanner()
    shown = [(i, t := secrets.replaced(x, scanner.scan([x])[0], "[SECRET]"), g, s, len(t), k) for i, x, g, s, n, k in left]
    assert hidden.columns == docs.columns and listed(hidden) == sorted(map(str, shown)) and "hunter2" not in str(shown)
    import public_tokenizers as tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    codec = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = C.run(spark, folder).toPandas()
    numbers = pd.DataFrame([(r[0], len(codec.encode_ordinary(r[1]))) for r in shown], columns=["doc_id", "n_tokens"])
    assert sorted(map(str, zip(got.doc_id.astype("Int64"), got.n_tokens))) == sorted(map(str, zip(numbers.doc_id.astype("Int64"), numbers.n_tokens)))


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stage_names():
    assert [n for n, _ in C.STAGES] == ["quality rules", "near duplicates", "benchmark", "secrets", "tokens"]
