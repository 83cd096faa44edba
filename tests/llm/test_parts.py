"""Keys of parts: sets that reach the threshold share one, and the join by parts loses no link."""

import random

import numpy as np
import pytest

from rasterloom.llm import common, ngram_join

from .test_corpus_ops import SCHEMA, corpus, ngram_sets


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 0.95])
def test_linked_sets_share_a_part(threshold):
    rng, parts, linked = random.Random(3), ngram_join.Parts(threshold), 0
    for size in (1, 2, 8, 9, 10, 20, 50, 300, 900):
        for _ in range(100):
            base = rng.sample(range(2**60), size)
            other = set(base)
            for _ in range(rng.randint(0, int(size * (1 - threshold) * 1.2) + 1)):
                if rng.random() < 0.5:
                    other.discard(rng.choice(base))
                if rng.random() < 0.5:
                    other.add(rng.randrange(2**60))
            both, either = len(other & set(base)), len(other | set(base))
            if other == set(base) or not other or both < threshold * either:
                continue
            a, b = (parts.keys(np.array(sorted(s), np.uint64)) for s in (base, other))
            linked += 1
            assert len(np.intersect1d(a, b))
    assert linked > 100
    assert not len(parts.keys(np.zeros(0, np.uint64)))


@pytest.mark.parametrize("n,threshold", [(3, 90), (5, 80)])
def test_join_by_parts(spark, n, threshold):
    rng = random.Random(8)
    rows = corpus()
    for base in (3, 7, 20):  # copies with so many edits that some are linked only with one another
        words = rows[base][1].split()
        for k in range(25):
            own = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                own[rng.randrange(len(own))] = f"e{k}{rng.randrange(99)}"
            rows.append((len(rows), " ".join(own), *rows[0][2:]))
    docs = common.keep(spark.createDataFrame(rows, SCHEMA).repartition(5))
    sets = ngram_sets(rows, n)
    component = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while any(component[a] != component[b] for a, b in links):
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs, n, threshold / 100, by_parts=True).collect()}
    assert found == {i: (len(sets[i]), component[i]) for i in sets}
    assert ngram_join.groups(docs.limit(0), n, by_parts=True).count() == 0
    odd = [(None, rows[3][1]), (None, None), (4, rows[3][1]), (4, rows[3][1]), (4, "other"), (2, "short")]
    got = ngram_join.groups(spark.createDataFrame(odd, "doc_id long, text string"), n, by_parts=True).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("2", "2"), ("4", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("None", "None")]
