import random

from pyspark.sql import functions as F

from tidemark.llm import quality_classifier as Q


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("the of and river mountain house walking green letter summer about between table winter".split())
    docs, labels = [], []
    for i in range(900):
        good, toxic = rng.random() > 0.2, rng.random() < 0.2
        text = [word() + ("" if good else rng.choice(["$$$", "###", "***"])) for _ in range(rng.randint(20, 80))]
        if toxic:
            text[rng.randrange(len(text))] = "vileword"
        docs.append((i, " ".join(text), f"src{i % 7}", "en" if i % 2 else None, 1))
        labels.append((i, int(good), int(toxic)))
    docs += [(5000, None, None, None, 1), (5001, "", "src0", "en", 1), (0, docs[0][1], "src0", None, 1), (None, docs[1][1], "src1", "en", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, kept int")
    known = spark.createDataFrame([r for r in labels if r[0] % 2] + [(99999, 1, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(frame, known).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    held = [r for r in labels if r[0] % 2 == 0]
    assert sum(by[i].kept == bool(q and not t) for i, q, t in held) >= 0.97 * len(held)
    again = Q.classify(frame.repartition(5), known).collect()
    assert {(r.doc_id, r.p_quality, r.p_toxic) for r in again} == {(r.doc_id, r.p_quality, r.p_toxic) for r in got}


def test_sparse_sites_stay_near_the_rest(spark):
    docs = spark.createDataFrame([(i, "plain words here", "big", "en") for i in range(50)] + [(100, "plain words here", "tiny", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert abs(got[100].path_quality - got[0].path_quality) < 0.05


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classify(none, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s", "en")], none.schema)
    assert Q.classify(one, labels).count() == 1 and Q.classify(one, labels).where(F.col("p_quality").isNull()).count() == 0
