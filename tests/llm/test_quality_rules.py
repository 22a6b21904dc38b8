import random
import re
from collections import Counter

from tidemark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_counts(spark):
    rng = random.Random(2)
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "a b c d e f g h " * 30, "xx"), (5, "a " * 40, None), (5, "a " * 40, None), (None, "é# $x\x0b<y>\nz\nz\n \n \n", "fr")]
    rows += [(10 + i, "".join(rng.choice(["a", "b", "the", "é"]) + rng.choice([" ", "\n", "  ", " x "]) for _ in range(rng.randint(1, 150))), "en") for i in range(80)]
    got = Q.judge(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, _words string")).collect()
    want = sorted((str(i), *brute(t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_far_from_the_language(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice("the of and to in river mountain house walking green letter summer".split()) for _ in range(150))
    rows = [(i, plain(), "en") for i in range(60)] + [(90, " ".join(w + "***" for w in plain().upper().split()), "en"), (91, "#$% " * 10 + "short but more than twenty words " * 3, "en")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(60)) and not got[90].kept and got[90].char_distance > Q.MAX_CHAR_DISTANCE
    assert got[91].char_distance is None


def test_only_the_words_are_far(spark):
    rng = random.Random(6)
    other = "river mountain house walking green letter summer window garden paper".split()

    def text(common, n=150):
        return " ".join(rng.choice(common) if common and rng.random() < 0.2 else rng.choice(other) for _ in range(n))

    rows = [(i, text(Q.COMMON_WORDS["en"]), "en") for i in range(60)] + [(100 + i, text(Q.COMMON_WORDS["de"]), "de") for i in range(60)]
    rows += [(200, text([]), "en"), (201, text(Q.COMMON_WORDS["de"]), "en"), (202, text(Q.COMMON_WORDS["en"]), "de"), (203, " ".join(rng.choice(other) for _ in range(90)).replace(" ", " | "), "en")]
    rows += [(300, text(Q.COMMON_WORDS["de"]), None), (301, text([]), None)] + [(310 + i, text([]), "pl") for i in range(5)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.char_distance <= Q.MAX_CHAR_DISTANCE and r.word_distance < Q.MAX_WORD_DISTANCE and not r.base_failed for r in got.values())
    assert sorted(i for i, r in got.items() if not r.kept) == [200, 201, 202, 203]


def test_reference_without_its_common_words(spark):
    """Where nearly no text uses the list, a text without it isn't far from the others."""
    rows = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(45)) + " one more line of text here for it" * 2 * (i == 0) + " x y z" * 6, "en") for i in range(30)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("not base_failed").collect()
    assert len(got) >= 29 and all(r.word_distance is not None and r.kept for r in got if r.doc_id)


def test_clashing_names(spark):
    """Columns named like those of the result give way in ``judge`` and stay in ``keep``; inner names don't matter."""
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "a", 5, "w", "r"), (2, "short", "en", "b", 6, "w", "r"), (None, good, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, q_n_words int, _sorted string, row string")
    got = Q.judge(frame)
    assert got.columns.count("kept") == got.columns.count("q_n_words") == 1
    assert sorted(((r.doc_id, r.kept, r._sorted) for r in got.collect()), key=str) == [(1, True, "w"), (2, False, "w"), (None, True, None)]
    kept = Q.keep(frame)
    assert kept.columns == frame.columns and sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_long_text(spark):
    words = [f"w{i % 9973}" for i in range(60_000)]
    row = Q.judge(spark.createDataFrame([(1, " ".join(words), "en")], "doc_id long, text string, lang string")).first()
    assert (row.q_n_words, row.q_n_repeat_words) == (60_000, 60_000)


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
