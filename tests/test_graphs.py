"""Orders, levels, bounds and walks, past all depths that were once fixed, against plain models."""

from __future__ import annotations

import random
from collections import deque

import pytest

from rasterloom.operators import graphs, layers


def queue_order(nodes, edges):
    """nodes: (id, seq); the order of a queue, and the longest way to each node."""
    ids, after, missing = {i for i, _ in nodes}, {}, {i: 0 for i, _ in nodes}
    for a, b in {e for e in edges if e[0] in ids and e[1] in ids}:
        after.setdefault(a, []).append(b)
        missing[b] += 1
    seq = dict(nodes)
    ready = deque(sorted(i for i, n in missing.items() if not n))
    out, level = [], dict.fromkeys(ids, 0)
    while ready:
        node = ready.popleft()
        out.append(node)
        for b in sorted(after.get(node, []), key=lambda k: (seq[k], k)):
            level[b] = max(level[b], level[node] + 1)
            missing[b] -= 1
            if not missing[b]:
                ready.append(b)
    return out, level


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id long, seq int"), spark.createDataFrame(edges, "a long, b long")


def test_random_graphs_in_the_order_of_a_queue(spark):
    rng = random.Random(1)
    nodes = [(k * 3, rng.randint(0, 9)) for k in rng.sample(range(1000), 60)]
    rank = {i: k for k, (i, _) in enumerate(nodes)}
    edges = [e for e in ((rng.choice(nodes)[0], rng.choice(nodes)[0]) for _ in range(150)) if rank[e[0]] < rank[e[1]]]
    edges += edges[:9] + [(5000, nodes[0][0]), (nodes[0][0], 5001)]  # repeated, and of unknown nodes
    got = graphs.ordered(*frames(spark, nodes, edges)).orderBy("place").collect()
    order, level = queue_order(nodes, edges)
    assert [r.place for r in got] == list(range(60))
    assert [r.id for r in got] == order and {r.id: r.level for r in got} == level


def test_a_chain_longer_than_any_fixed_number_of_rounds(spark):
    chain = [(k, k + 1) for k in range(20)]
    nodes = spark.createDataFrame([(k,) for k in range(21)], "id long")
    got = graphs.levels(spark.createDataFrame(chain, "a long, b long"), nodes).collect()
    assert sorted((r.id, r.level) for r in got) == [(k, k) for k in range(21)]


def test_a_cycle_is_named(spark):
    nodes, edges = [(k, 0) for k in range(9)], [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)]
    with pytest.raises(graphs.Cycle) as error:
        graphs.ordered(*frames(spark, nodes, edges))
    cycle = error.value.nodes
    assert cycle[0] == cycle[-1] and set(cycle) == {1, 2, 3} and set(zip(cycle, cycle[1:])) <= set(edges)
    with pytest.raises(graphs.Cycle):
        graphs.ordered(*frames(spark, [(1, 0)], [(1, 1)]))


def test_empty_graphs(spark):
    assert graphs.ordered(*frames(spark, [], [])).collect() == []
    assert graphs.walked(spark.createDataFrame([], "id long, parent long")).collect() == []


def test_bounds_of_a_deep_tree(spark):
    rows = [(k, k - 1 if k else None, 5 * k, k, 3 if k % 2 else 0, 4) for k in range(15)]
    df = spark.createDataFrame(rows, "id long, parent long, x int, y int, w int, h int")
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in layers.tree_bounds(df).collect()}
    for k in range(15):
        boxes = [(x, y, x + w, y + h) for i, _, x, y, w, h in rows if i >= k and w]
        want = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (None,) * 4
        assert got[k] == want
    loop = spark.createDataFrame([(1, 2, 0, 0, 1, 1), (2, 1, 0, 0, 1, 1)], "id long, parent long, x int, y int, w int, h int")
    with pytest.raises(graphs.Cycle):
        layers.tree_bounds(loop)


def test_walks_keep_long_ids_apart(spark):
    rows = [(1, None), (1234567, 1), (1234568, 1), (10**18, 1234567), (2, 1), (77, 88)]
    got = graphs.walked(spark.createDataFrame(rows, "id long, parent long")).orderBy("path").collect()
    assert [(r.id, r.depth) for r in got] == [(1, 0), (2, 1), (1234567, 1), (10**18, 2), (1234568, 1)]  # 77 lies under no root
