import math
import random
import re

from tidemark.llm import pii as P


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    for k, (pattern, ok) in enumerate(checks.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return [(P.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_base_spans(spark):
    rng = random.Random(7)
    texts = [None, "", "é😀 a.b@c.d.e, x@y@z.co 1.2.3.4.5 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+49 (30) 123456-78 +1 +12 34 + 5", "a@b.com_x@y.z a@b.c.", "1" * 3000, "1 " * 3000, "a" * 20000, "+1" + " " * 500 + "2 3456789 0"]
    texts += ["".join(rng.choice(["a", "b@", ".c", "1", "23", "4111111111111111", ".", " ", "-", "+4", "(", "é", "@", "_"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "again"), (None, texts[3], None)]
    got = P.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.spans if s.kind != "term"]) for r in got) == sorted((str(i), brute(t)) for i, t, _ in rows)
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_disclosing_terms(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("river mountain house walking green letter summer about between".split())
    rows = [(i, " ".join(word() for _ in range(20)) + f" user{i}@mail.example") for i in range(700)]
    rows += [(1000 + i, f"ask {word()} Quibblesworth, boss@corp.example {word()}") for i in range(4)] + [(2000, "The quibblesworth file: QUIBBLESWORTH"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.find(docs).collect()}
    assert got[2000] == [("term", 4, 17), ("term", 24, 37)]
    assert [k for k, _, _ in got[1000]] == ["term", "email"] and all(k == "email" for i in range(700) for k, _, _ in got[i])
    clean = {r.doc_id: r.sanitised for r in P.sanitise(docs).collect()}
    assert clean[2000] == "The [TERM] file: [TERM]" and clean[2001] is None and clean[5].endswith(" [EMAIL]")


def test_terms_of_the_whole_document(spark):
    """Terms far from the value, and short names, disclose it; the rarest are removed."""
    rng = random.Random(3)
    word = lambda: rng.choice("river mountain house walking green letter summer about between".split())
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, filler(15)) for i in range(600)]
    rows += [(1000 + i, f"Quibblesworth {filler(40)} boss@corp.example {filler(40)} Li") for i in range(3)]
    rows += [(2000, "about quibblesworth and Li here"), (2001, "a line between")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = P.base_spans(docs)
    terms = {r.term: r.bits for r in P.disclosing_terms(base, docs).collect()}
    assert set(terms) == {"quibblesworth", "li"}
    assert all(abs(b - math.log2(3 / 4 * len(rows) / 3)) < 1e-9 for b in terms.values())
    old, P.REMOVE_BITS = P.REMOVE_BITS, 7.0
    try:
        assert {r.doc_id: r.sanitised for r in P.sanitise(docs).collect()}[2000] == "about  and  here"
    finally:
        P.REMOVE_BITS = old
    clean = {r.doc_id: r.sanitised for r in P.sanitise(docs).collect()}
    assert clean[2000] == "about [TERM] and [TERM] here" and clean[2001] == "a line between"
    assert clean[1000].startswith("[TERM] ") and clean[1000].endswith(" [TERM]")


def test_many_matches_in_one_text(spark):
    """Places of tens of thousands of values are those of brute force."""
    text = " ".join(f"é{i} user{i}@mail.example 10.0.{i % 256}.{i % 300}" for i in range(20_000))
    got = P.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in got.spans if s.kind != "term"] == brute(text)
    for n in (255, 256, 257, 512, 513):
        text = " ".join(f"u{i}@m.org" for i in range(n))
        assert [tuple(s) for s in P.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans] == brute(text)


def test_sanitise_clashing_names(spark):
    rows = [(1, "mail a@b.org now", "x", "y"), (None, None, "x", None), (2, "", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, sanitised string")
    got = P.sanitise(frame)
    assert got.columns == ["doc_id", "text", "spans", "sanitised"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "mail a@b.org now", "x", "mail [EMAIL] now"), (None, None, "x", None), (2, "", None, "")], key=str)


def test_work_grows_with_the_length_of_a_text(spark):
    """Many equal values in one text: their terms and what replaces them are found in time, and rightly."""
    import time

    n = 20_000
    rows = [(i, "Ada Quibble same@mail.example and then some. " * n) for i in range(4)] + [(9, "no value here"), (10, "quibble")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    clean = {r.doc_id: r.sanitised for r in P.sanitise(docs).collect()}
    assert time.time() - began < 150  # a quadratic form takes many times that
    assert clean[0].count("[EMAIL]") == n and "same@" not in clean[0] and clean[9] == "no value here"


def test_replacing_overlapping_spans_by_hand(spark):
    rng = random.Random(8)
    for n in (0, 1, 3, 255, 257, 700):
        text = "".join(rng.choice("aé😀 ") for _ in range(n * 5 + 7))
        spans = sorted((s, rng.choice(["email", "ip", "term", "removed"]), min(len(text), s + rng.randint(1, 9))) for s in (rng.randrange(len(text)) for _ in range(n)))
        at, out = 0, ""
        for s, k, e in spans:
            if s >= at:
                out += text[at:s] + ("" if k == "removed" else f"[{k.upper()}]")
            at = max(at, e)
        frame = spark.createDataFrame([(text, [(k, s, e) for s, k, e in spans])], "text string, spans array<struct<kind:string,start:int,end:int>>")
        assert frame.select(P.F.array_join(P._replaced("text", "spans"), "")).first()[0] == out + text[at:]
