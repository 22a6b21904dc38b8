import random

from tidemark.llm import decontaminate as D


def distance(item, text):
    """Smallest edit distance of the item to any part of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(i), lambda: chars.insert(i, "z"), lambda: chars.__setitem__(i, "q")])()
    return "".join(chars)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 20)))) for i in range(12)] + [(50, None), (51, "  "), (52, "ab cd"), (3, "second text of three")]
    docs = []
    for d in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 40)))
        if d % 2:
            item = rng.choice(items[:12])[1]
            text = f"{text}\n {edited(rng, item, rng.randint(0, int(len(item) * 0.15)))}  {text.upper()}"
        docs.append((d, text, "x"))
    docs += [(500, None, "x"), (501, "", "x"), (1, docs[1][1], "again"), (None, items[0][1], "null id")]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), i, distance(n, D.normal(t))) for d, t, _ in docs for i, x in items if (n := D.normal(x)) and distance(n, D.normal(t)) <= min(int(D.ERROR_RATE * len(n)), len(n) - 1))
    for limit in (D.ITEM_CHARS, 300):
        got = D.matches(frame, tests, item_chars=limit).collect()
        assert sorted((str(r.doc_id), r.item_id, r.distance) for r in got) == want and len(want) > 20
    texts = {d: D.normal(t) for d, t, _ in docs}
    by_item = {i: D.normal(t) for i, t in items[:12] if i != 3}
    for r in got:
        if r.item_id in by_item:
            assert distance(texts[r.doc_id][r.start : r.end], by_item[r.item_id]) <= r.distance
    held = {t for _, t, _ in docs for i, x in items if (n := D.normal(x)) and distance(n, D.normal(t)) <= min(int(D.ERROR_RATE * len(n)), len(n) - 1)}
    for limit in (D.ITEM_CHARS, 300):
        assert sorted(map(str, map(tuple, D.clean(frame, tests, item_chars=limit).collect()))) == sorted(str(d) for d in docs if d[1] not in held)


def test_clean_judges_rows(spark):
    """Null ids go like others, and a clean text stays though its id has a contaminated one."""
    item = "which river runs by the old mill at noon"
    rows = [(1, f"so {item} they say"), (1, "a clean text"), (None, item), (None, "clean"), (2, "word " * 30_000 + item), (3, "word " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.clean(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[1], rows[3], rows[5]]))


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(none, items).count() == 0 and D.matches(some, items).count() == 0 and D.clean(some, items).count() == 1
