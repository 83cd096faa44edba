"""The prefix tree of the n-gram join against comparing every pair."""

import random

import numpy as np
import pytest

from rasterloom.llm.ngram_join import PrefixTree, Stored


def some_sets(rng, count, size):
    base = rng.sample(range(10_000), size)
    out = []
    for _ in range(count):
        own = set(base[rng.randrange(3) :]) if rng.random() < 0.7 else set(rng.sample(range(10_000), rng.randint(1, size)))
        for _ in range(rng.randint(0, size // 5)):
            own.discard(rng.choice(base))
            own.add(rng.randrange(10_000, 20_000) if rng.random() < 0.3 else rng.randrange(10_000))
        out.append(np.array(sorted(own), np.uint64))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_whole_sets(threshold):
    rng = random.Random(1)
    for size in (1, 5, 40, 300):
        sets = some_sets(rng, 60, size)
        tree = PrefixTree([Stored(i, s, len(s), len(s)) for i, s in enumerate(sets)], threshold)
        for s in sets:
            want = {i for i, o in enumerate(sets) if (x := len(np.intersect1d(s, o))) >= threshold * (len(s) + len(o) - x) - 1e-9}
            assert set(tree.search(Stored(-1, s, len(s), len(s)))) == want
    assert PrefixTree([], threshold).search(Stored(0, sets[0], 1, 1)) == []


@pytest.mark.parametrize("tail", [1, 3, 16])
@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_tails_lose_no_pair(threshold, tail):
    """Of sets that share a first key, each pair over the threshold is admitted, and fewer than all pairs are."""
    rng, admitted, pairs = random.Random(2), 0, 0
    for size in (4, 30, 120):
        sets = some_sets(rng, 80, size)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = np.intersect1d(a, b)
                if not len(both) or i == j:
                    continue
                x, y = (int(np.searchsorted(s, both[0])) for s in (a, b))
                tree = PrefixTree([Stored(j, b[y : y + tail], len(b), len(b) - y)], threshold)
                found = tree.search(Stored(i, a[x : x + tail], len(a), len(a) - x)) == [j]
                assert found or len(both) < threshold * (len(a) + len(b) - len(both)) - 1e-9
                admitted, pairs = admitted + found, pairs + 1
    assert admitted < pairs


def test_long_chains_need_no_recursion():
    sets = [np.arange(k, dtype=np.uint64) for k in range(1, 3000)]
    tree = PrefixTree([Stored(len(s), s, len(s), len(s)) for s in sets], 0.9)
    assert sorted(tree.search(Stored(0, sets[-1], 2999, 2999))) == list(range(2700, 3000))
