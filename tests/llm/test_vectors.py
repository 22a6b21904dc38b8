import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quantise, whitening
from tidemark.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vec int, component string"


def table(spark, vectors, labels=None):
    rows = [(i, v, labels[i] if labels else None, "clash", 1, "x") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def bad_rows(d):
    return [(900, None), (901, [None] * d), (902, [1.0] * (d - 1) + [math.nan]), (903, [1.0] * (d - 1) + [math.inf]), (904, [-math.inf] + [0.0] * (d - 1)), (905, [1.0] * (d - 1) + [None])]


def longs(scale, shift):
    vector = F.col("embedding").cast("array<double>")
    return F.when(usable(vector), F.transform(vector, lambda c: F.floor(c * float(scale)) + shift))


def whitened_by_eigh(x, components):
    x = np.array(x, dtype="int64")
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(axis=1), c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_as_by_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    d, n = 40, 400
    data = rng.standard_normal((n, d)) * np.linspace(0.3, 0.1, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])]  # repeated rows and null ids count
    got = whitening.whiten(table(spark, rows + bad_rows(d)), longs(1024, 100000)).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    deviation, white, explained = whitened_by_eigh(x, 8)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    assert all(r.identity_error < 1e-12 for r in got)
    sign = {}
    for r in got:
        if r.vec_id == 0:
            sign[r.component] = np.sign(r.whitened * white[0, r.component - 1])
    for r in got:
        if r.vec_id is not None:
            assert r.deviation == deviation[r.vec_id]
            assert abs(r.whitened * sign[r.component] - white[r.vec_id, r.component - 1]) < 1e-9
            assert abs(r.explained / explained[r.component - 1] - 1) < 1e-12


def test_whitening_of_few_equal_or_no_rows(spark):
    assert whitening.whiten(table(spark, []), longs(1024, 0)).count() == 0
    assert whitening.whiten(table(spark, bad_rows(4)), longs(1024, 0)).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(9)]), longs(1024, 0)).count() == 0
    two = whitening.whiten(table(spark, [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])]), longs(1024, 0)).collect()
    assert {r.component for r in two} == {1} and all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in two)
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(0, [1.0]), (1, [1.0, 2.0])]), longs(1024, 0))


def test_whitening_with_ties(spark):
    """Equal eigenvalues: any basis of their space, still white."""
    rows = [(2 * i + s, [float(s * 2 - 1) if j == i else 0.0 for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(table(spark, rows), longs(1024, 0), components=3).collect()
    assert len(got) == 36 and all(r.identity_error < 1e-12 and abs(r.explained - 1 / 6) < 1e-12 for r in got)


@pytest.mark.parametrize("d,components,gap", [(30, 3, 1.0), (300, 8, 0.02), (200, 5, 0.0)])
def test_lobpcg_certifies(d, components, gap):
    rng = np.random.default_rng(d)
    values = np.sort(np.concatenate([rng.random(d - components), 1.0 + gap + np.arange(components) * max(gap, 1e-3)]))[::-1]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = q * values @ q.T
    found, vectors, norms, _ = whitening.lobpcg(lambda b: a @ b, d, components)
    assert np.abs(found - values[:components]).max() < 1e-11 and norms.max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(components)).max() < 1e-12


def test_lobpcg_says_when_it_fails():
    a = np.diag(np.linspace(1, 2, 100))
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: a @ b, 100, 4, 0, rounds=3)


def by_scan(rows, parts, entries, rounds):
    """Codes and errors by comparing each part with each entry."""
    kept = [(i, v, label) for i, v, label in rows]
    size = len(kept[0][1]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))[:entries]
    books = [[list(v[p * size : (p + 1) * size]) for _, v, _ in start] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = v[p * size : (p + 1) * size]
                groups.setdefault(nearest(book, part)[1], []).append(part)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    out = []
    for i, v, label in kept:
        found = [nearest(b, v[p * size : (p + 1) * size]) for p, b in enumerate(books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str), books


def test_codes_as_by_a_scan(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(16)]) for i in rng.sample(range(800), 300)]  # many ties
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, [0.0] * 16)]
    labels = {i: rng.choice([0, 1, None]) for i, _ in rows + bad_rows(16)}
    got = quantise.compress(table(spark, rows + bad_rows(16), labels), longs(4096, 0), parts=8).collect()
    whole = [(i, [math.floor(4096 * np.float64(np.float32(c))) for c in v], labels[i]) for i, v in rows]
    want, books = by_scan(whole, 8, 16, 6)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    text = ",".join(str(c) for b in books for e in b for c in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_tree_finds_the_lowest_of_equal_entries():
    rng = np.random.default_rng(2)
    for _ in range(200):
        entries = rng.integers(-2, 3, (rng.integers(1, 20), 3))
        points = rng.integers(-3, 4, (50, 3))
        index, distance = quantise.KdTree(entries).nearest(points)
        all_of = ((points[:, None] - entries) ** 2).sum(axis=2)
        assert (index == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()


def test_codes_of_few_no_and_unfit_rows(spark):
    assert quantise.compress(table(spark, []), longs(4096, 0)).count() == 0
    one = quantise.compress(table(spark, [(7, [0.5] * 8)]), longs(4096, 0)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(7, "00" * 8, 0, 0)]
    for rows in ([(0, [1.0] * 7)], [(0, [1.0] * 8), (1, [1.0] * 16)]):
        with pytest.raises(ValueError):
            quantise.compress(table(spark, rows), longs(4096, 0))
    with pytest.raises(Exception, match="don't fit"):
        quantise.compress(table(spark, [(0, [1e7] * 8)]), longs(4096, 0)).collect()
