"""Values by jumping against stepping, torn images and smooth lines against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import chance
from rasterloom.operators import smooth


def test_jumping_equals_stepping(spark):
    places = [1, 2, 3, 1000, 65535, 65536, 99_999]
    state, want = chance.START, {}
    for k in range(1, max(places) + 1):
        state = (state * chance.MULTIPLIER + chance.CONSTANT) & chance.MASK
        if k in places:
            want[k] = (state >> 11) / 2**53
    rows = spark.createDataFrame([(k,) for k in [*places, 0, -1, 2**48, None]], "k long")
    got = {r.k: r.v for r in rows.select("k", chance.rand(F.col("k")).alias("v")).collect()}
    assert {k: got[k] for k in places} == want
    assert got[0] is got[-1] is got[2**48] is got[None] is None


def test_far_places_and_other_generators(spark):
    far = 2**47 + 12345
    state, (m, c) = 99, (0xFFFFFFFFFFFFFFFD, 0xFFFFFFFFFFFFFFF1)
    for bit, (a, b) in enumerate(chance.jumps(m, c)):
        if far >> bit & 1:
            state = (state * a + b) & chance.MASK
    row = spark.range(1).select(chance.state_after(F.lit(far), 99, m, c).alias("s")).first().s
    assert sum(v << 16 * i for i, v in enumerate(row)) == state
    assert pow(m, far, 1 << 64) == __import__("functools").reduce(lambda x, j: x * j[1][0] & chance.MASK if far >> j[0] & 1 else x, enumerate(chance.jumps(m, c)), 1)


@pytest.mark.parametrize("w, h, strip, most, seed", [(8, 8, 2, 3, 20), (5, 9, 4, 12, 1), (3, 3, 9, 0, 77)])
def test_torn_images(w, h, strip, most, seed):
    stack = np.random.default_rng(seed).integers(0, 256, (2, h, w, 4))
    got = smooth.torn(strip, most, seed)(stack)
    state, want = seed, stack.copy()

    def draw():
        nonlocal state
        state = (state * 1664525 + 1013904223) % 2**32
        return state

    for y in range(0, h, strip):
        end, shift = min(h, y + strip + draw() % 5), 0
        if draw() % 10 < 7:
            v = draw()
            v = v - 2**32 if v >= 2**31 else v
            shift = int(np.fmod(v, most * 2)) - most if most else 0
        apart = draw() % 10 < 3
        for sy in range(y, end):
            for sx in range(w):
                at = (sx + shift) % w
                red, blue = at, at
                if apart:
                    red = min(max(at + draw() % 5 - 2, 0), w - 1)
                    blue = min(max(at + draw() % 5 - 2, 0), w - 1)
                want[:, sy, sx] = np.stack([stack[:, sy, red, 0], stack[:, sy, at, 1], stack[:, sy, blue, 2], stack[:, sy, at, 3]], -1)
    assert (got == want).all()


def test_shares_of_a_line(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 5.0, 0.0), (0.0, 5.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (4.0, 3.5, 0.0, 1.5)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(smooth.smooth_line(*(F.col(c) for c in "abcd"))).collect()]
    inner = [(p.x, p.y, round(p.c, 9)) for p in got[0] if p.c > 0]
    assert sorted(inner) == [(0, 0, 0.5), (1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0), (4, 0, 1.0), (5, 0, 0.5)]
    assert sorted((p.y, p.x, round(p.c, 9)) for p in got[1] if p.c > 0) == sorted(inner)
    assert sorted((p.x, p.y, p.c) for p in got[2] if p.c > 0) == [(1, 1, 0.5), (1, 1, 0.5)]
    by_x = {}
    for p in got[3]:
        by_x[p.x] = by_x.get(p.x, 0) + p.c
    assert by_x == {0: 0.5, 1: 1.0, 2: 1.0, 3: 1.0, 4: 0.5}
