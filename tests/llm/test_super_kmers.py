"""Removal of repeated word windows against all windows in Python dictionaries."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from rasterloom.llm import super_kmers
from rasterloom.llm.super_kmers import Shape

SCHEMA = "doc_id long, text string, n_words string, bucket int"


def plain(docs, shape):
    w, first = shape.window, {}
    rank = lambda i: 2**63 - 1 if i is None else i
    cut = [(i, (t or "").encode().split()) for i, t in docs]
    for i, words in cut:
        for at in range(len(words) - w + 1):
            g = tuple(words[at : at + w])
            first[g] = min(first.get(g, 2**63), rank(i))
    out = []
    for i, words in cut:
        gone = set()
        for at in range(len(words) - w + 1):
            if first[tuple(words[at : at + w])] < rank(i):
                gone |= set(range(at, at + w))
        kept = b" ".join(x for k, x in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def held(spark, docs, shape, parts=4):
    frame = spark.createDataFrame([(i, t, "other", 3) for i, t in docs], SCHEMA).repartition(parts)
    got = super_kmers.removals(frame, shape, with_text=True).collect()
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == plain(docs, shape)


@pytest.mark.parametrize("seed, shape", [(0, Shape(5, 2)), (1, Shape(7, 3)), (2, Shape(4, 4)), (3, Shape(6, 1))])
def test_random_texts_of_few_words(spark, seed, shape):
    rng = np.random.default_rng(seed)
    some = ["a", "b", "ä", "cc", "d\x00d"]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", "\n", "  ", "\t\x0b"]) for _ in range(n))
    docs = [(int(rng.integers(0, 60)) if k % 9 else None, text(int(rng.integers(0, 40)))) for k in range(120)]
    docs += [docs[3], docs[3], (5, None), (6, ""), (7, " \n "), (None, None), (2**63 - 1, "a b a b a b a b"), (-4, docs[8][1])]
    held(spark, docs, shape)


def test_a_passage_in_many_documents(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 3000)}"
    words = lambda n: [word() for _ in range(n)]
    shared, other = words(30), words(12)
    docs = []
    for k in range(400):
        middle = shared if k % 3 else other * 2
        docs.append((int(rng.integers(0, 350)), " ".join(words(int(rng.integers(0, 20))) + middle + words(int(rng.integers(0, 9))))))
    shape = Shape(10, 3, least=2, batch=2000)
    frame = spark.createDataFrame([(i, t, "other", 3) for i, t in docs], SCHEMA)
    texts = frame.selectExpr("doc_id AS doc", "xxhash64(text) AS text", "CAST(text AS BINARY) AS data")
    assert len(super_kmers.frequent_grams(texts, shape)) > 20
    held(spark, docs, shape)
    held(spark, docs, shape._replace(held=100))


def test_texts_longer_than_a_batch(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{rng.integers(0, 12)}" for _ in range(n))
    long = text(3000)
    held(spark, [(4, long), (1, long[500:2500]), (9, text(300)), (3, "w1 " * 900)], Shape(8, 3, batch=200, bucket=500), parts=2)


def test_no_rows(spark):
    empty = super_kmers.removals(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] and empty.collect() == []
