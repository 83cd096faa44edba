"""Codes of vectors against Lloyd's method in plain Python, and bounds against full scans."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rasterloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int"


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, label, "other", 9) for i, v, label in vectors], SCHEMA).repartition(3)


def plain(vectors, parts, entries, rounds, factor):
    width = -(-max((len(v) for _, v, _ in vectors), default=0) // parts) * parts
    step = width // parts
    rows = [(i, [math.floor(factor * c) for c in v] + [0] * (width - len(v)), label) for i, v, label in vectors]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[p * step : (p + 1) * step] for _, x, _ in first] for p in range(parts)]
    cut = lambda x, p: x[p * step : (p + 1) * step]
    far = lambda a, b: sum((u - w) ** 2 for u, w in zip(a, b))
    near = lambda z, book: min(range(len(book)), key=lambda e: (far(z, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x, _ in rows:
                groups.setdefault(near(cut(x, p), books[p]), []).append(cut(x, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(v) for book in books for z in book for v in z).encode()).hexdigest()
    out, totals = [], {}
    for i, x, label in rows:
        code = [near(cut(x, p), books[p]) for p in range(parts)]
        error = sum(far(cut(x, p), books[p][e]) for p, e in enumerate(code))
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    fits = lambda n: n if n < 2**63 else None
    return sorted(((i, c, fits(e), fits(totals[label]), digest) for i, c, e, label in out), key=repr)


def run(spark, vectors, **how):
    how = {"parts": 2, "entries": 5, "rounds": 4, "factor": 8} | how
    got = vector_codes.compress(rows_of(spark, vectors), **how).collect()
    return sorted(map(tuple, got), key=repr), how


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ties_and_repeats(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [(int(i), [float(v) for v in rng.integers(-3, 4, 6)], [None, 1, 2][k % 3]) for k, i in enumerate(rng.permutation(70))]
    vectors += [(200 + k, vectors[0][1], 7) for k in range(30)] + [vectors[3], (None, vectors[4][1], None), (5, vectors[9][1], 1)]
    got, how = run(spark, vectors)
    assert got == plain(vectors, **how)


def test_padding_few_rows_and_dropped_rows(spark):
    good = [(4, [1.0, 2.0, -1.3], 1), (2, [0.5], None), (9, [], 1)]
    bad = [(1, None, 1), (3, [None, 1.0], 1), (5, [float("nan")], 1), (6, [float("-inf"), 1.0], 2)]
    got, how = run(spark, good + bad)
    assert got == plain(good, **how)
    assert run(spark, [])[0] == [] and run(spark, bad)[0] == []


def test_numbers_beyond_64_bits(spark):
    vectors = [(k, [float(3 * 10**17 * (k % 7 - 3)), float(k), -2.0, 1e17 * (k % 3)], k % 2) for k in range(40)]
    got, how = run(spark, vectors, factor=2)
    assert got == plain(vectors, **how) and any(r[2] is None for r in got)


def test_bounds_skip_and_agree_with_scans():
    rng = np.random.default_rng(5)
    x = rng.integers(-4000, 4000, (5000, 8))
    entries = x[:16].copy()
    book = vector_codes.Book(entries)
    near, upper, lower = book.scan(x)
    scanned = []
    for _ in range(8):
        after = np.array([x[near == e].sum(axis=0) // max(1, (near == e).sum()) for e in range(16)])
        book, entries = vector_codes.Book(after, entries), after
        scanned.append(book.moved(x, near, upper, lower))
        far = book.squares(x)
        assert (near == far.argmin(axis=1)).all()
        exact = np.sqrt(np.sort(far, axis=1)[:, :2].astype(float))
        assert (upper >= exact[:, 0]).all() and (lower <= exact[:, 1]).all()
    assert scanned[-1] < 5000


def test_label_totals_of_many_labels(spark):
    rows = [(k, [float(k % 11), float(k % 5)], 0 if k % 3 == 0 else k) for k in range(900)]
    got, how = run(spark, rows, entries=3, rounds=1)
    assert got == plain(rows, **how)
