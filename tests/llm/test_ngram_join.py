import random
import re

from tidemark.llm import ngram_join as J


def brute_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute(rows):
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(rng, groups, most):
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "é", "delta", "x1", "y2", "zeta", "eta", "theta"])
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word() + str(rng.randrange(1000))
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy))
    return [(i, t) for i, t in enumerate(rows)]


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    return sorted((tuple(r) for r in J.components(frame).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(random.Random(1), 40, 9)
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "one two"), (9004, "ONE\ttwo"), (5, rows[5][1]), (5, "other text under the same id five"), (None, rows[0][1]), (None, "alone without an id of its own"), (9005, "\x1c odd\x85")]
    assert run(spark, rows) == brute(rows)


def test_tiles_split(spark, monkeypatch):
    """Groups larger than a tile; the functions of the tasks take the limits when the plan is made."""
    monkeypatch.setattr(J, "TILE_ROWS", 4)
    monkeypatch.setattr(J, "SET_ROWS", 3)
    rows = corpus(random.Random(2), 6, 40)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bounds():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randint(1, 400), rng.randint(1, 400)
        least = int(J.needed(n, m))
        assert all((100 * i >= 80 * (n + m - i)) == (i >= least) for i in range(min(n, m) + 1))
        if least <= min(n, m):
            assert abs(J.band(n) - J.band(m)) <= 1


def test_full_prefix_and_long_texts(spark):
    """Texts of thousands of words, with the sketch and with the full prefix."""
    rng = random.Random(5)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(2500)]
        for edits in (0, 20, 70, 140):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    want = brute(rows)
    assert run(spark, rows) == want
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in J.components(frame, sketch=None).collect()), key=str) == want


def test_exact_pairs_of_a_tile():
    """The forest of a tile connects what brute force does, for narrow and wide signatures and split tiles."""
    rng = random.Random(6)
    for top in (60, 6000):
        sets = []
        for _ in range(12):
            base = {rng.randrange(1 << 60) for _ in range(rng.randint(1, top))}
            for _ in range(rng.randint(1, 5)):
                drop = set(rng.sample(sorted(base), rng.randint(0, len(base) // 6)))
                sets.append(J.np.array(sorted(base - drop), dtype=J.np.uint64))
        for side in (None, J.np.array([i % 2 for i in range(len(sets))])):
            root = list(range(len(sets)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            links = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j]) and 100 * J.common(sets[i], sets[j]) >= 80 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
            for i, j in links:
                root[find(i)] = find(j)
            want = {frozenset(k for k in range(len(sets)) if find(k) == find(i)) for i in range(len(sets))}
            root = list(range(len(sets)))
            for i, j in J.linked_pairs(sets, side):
                root[find(i)] = find(j)
            assert {frozenset(k for k in range(len(sets)) if find(k) == find(i)) for i in range(len(sets))} == want


def test_survivors(spark):
    """One row of each group, also without ids, with one id for several texts and with clashing names."""
    rng = random.Random(7)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(40)) for k in "abc")
    near = a.replace(a.split()[-1], "other")
    rows = [(1, a), (1, a), (None, a), (7, near), (1, b), (3, b), (None, c), (None, c), (9, None), (9, None), (10, ""), (11, " ")]
    frame = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, row string, times int")
    got = J.survivors(frame)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (9, None), (9, None), (10, ""), (11, " ")], key=str)
    assert J.survivors(frame.limit(0)).count() == 0


def test_linked_sets_meet_in_a_hash_that_neither_passes_over():
    """Whatever order the hashes are passed over in, and with as many edits as a link bears."""
    rng = random.Random(8)
    for _ in range(400):
        union = rng.sample(range(1 << 40), rng.randint(1, 190))
        common = -(-80 * len(union) // 100)
        rng.shuffle(union)
        side = [rng.random() < 0.5 for _ in union]
        a, b = (sorted(h for i, h in enumerate(union) if i < common or side[i] == own) for own in (True, False))
        if rng.random() < 0.5:  # the worst case: what the sets share comes last
            a, b = (sorted((union.index(h) < common, h) for h in s) for s in (a, b))
        files = {h: rng.random() for h in [*a, *b]}
        kept = [set(sorted(s[: J.prefix_length(len(s))], key=files.get)[: J.prefix_length(len(s)) - J.spare(len(s))]) for s in (a, b)]
        assert kept[0] & kept[1]


def test_common_passages_bring_no_texts_together(spark, monkeypatch):
    """Texts, short and of thousands of words, that share a line but are unlike are compared with nothing;
    the sets of long ones were taken for possible links before, and grew into one group."""
    counts, cut = {}, J.cut

    def counted(df, name):
        out = cut(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(J, "cut", counted)
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = text(9)
    rows = [(i, f"{text(60)} {line} {text(60)}") for i in range(60)]
    assert run(spark, rows) == brute(rows) and counts["files"] == counts["groups"] == 0
    passage = text(400)
    rows = [(i, f"{text(1400)} {passage} {text(1400)}") for i in range(30)]
    rows += [(40, rows[3][1] + " end"), (41, rows[4][1].replace(passage, passage[:-40]))]
    assert run(spark, rows) == brute(rows) and counts["groups"] == 4


def test_files_of_the_same_nodes_are_one(spark, monkeypatch):
    """Near copies share many hashes in two bands; they meet once for each set of texts that share some."""
    tiles, tiled = [], J._tiled

    def counted(rows, keys, *size):
        out = tiled(rows, keys, *size)
        tiles.append(out.select("tile").distinct().count())
        return out

    monkeypatch.setattr(J, "_tiled", counted)
    rng = random.Random(10)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [(1, base), (2, base + " end"), (3, base.replace(" ", "  ") + " other end")]
    assert run(spark, rows) == brute(rows) and tiles[0] <= 4
