"""The modes that take hue, saturation and luminosity apart, and modes named by rows, against plain formulas."""

from __future__ import annotations

from math import floor

import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions import blend


def lum(c):
    return 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]


def set_lum(c, to):
    c = [v + to - lum(c) for v in c]
    l, n, x = lum(c), min(c), max(c)
    if n < 0:
        c = [l + (v - l) * l / (l - n) if l - n > 1e-7 else l for v in c]
    if x > 1:
        c = [l + (v - l) * (1 - l) / (x - l) if x - l > 1e-7 else l for v in c]
    return c


def set_sat(c, to):
    n, x = min(c), max(c)
    return [(v - n) * to / (x - n) if x > n else 0.0 for v in c]


def sat(c):
    return max(c) - min(c)


MODELS = {
    "hue": lambda b, t: set_lum(set_sat(t, sat(b)), lum(b)), "saturation": lambda b, t: set_lum(set_sat(b, sat(t)), lum(b)),
    "color": lambda b, t: set_lum(t, lum(b)), "luminosity": lambda b, t: set_lum(b, lum(t)),
    "multiply": lambda b, t: [x * y for x, y in zip(b, t)], "exclusion": lambda b, t: [x + y - 2 * x * y for x, y in zip(b, t)],
    None: lambda b, t: t, "no such mode": lambda b, t: t,
}


def test_modes_named_by_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k, mode in enumerate(list(MODELS) * 60):
        p, q = (tuple(int(v) for v in rng.choice([0, 255, *rng.integers(0, 256, 4)], 4)) for _ in range(2))
        rows.append((k, mode, *p, *q, float(rng.choice([0.0, 0.4, 1.0]))))
    df = spark.createDataFrame(rows, "k int, mode string, " + ", ".join(f"{s}{c} int" for s in "pq" for c in "rgba") + ", o double")
    side = lambda s: {c: F.col(s + c) for c in "rgba"}
    got = {r.k: tuple(r.v) for r in df.select("k", blend.over(F.col("mode"), side("p"), side("q"), F.col("o")).alias("v")).collect()}
    fixed = {}
    for mode in blend.WHOLE:
        fixed |= {r.k: tuple(r.v) for r in df.filter(F.col("mode") == mode).select("k", blend.over(mode, side("p"), side("q"), F.col("o")).alias("v")).collect()}
    for k, mode, *v, o in rows:
        p, q = v[:4], v[4:]
        at, ab = q[3] / 255 * o, p[3] / 255
        want = tuple(p)
        if at > 0:
            ao = at + ab * (1 - at)
            mixed = MODELS[mode]([x / 255 for x in p[:3]], [x / 255 for x in q[:3]])
            byte = lambda x: floor(round(min(1, max(0, x)) * 255 + 0.5, 6))
            want = (*[byte((at * m + ab * b / 255 * (1 - at)) / ao) for m, b in zip(mixed, p)], byte(ao))
        assert got[k] == want, (mode, p, q, o)
        if k in fixed:
            assert fixed[k] == want
