"""Models for what SQL doesn't express, and the functions' odd cases."""

import random
from collections import Counter
from math import cos, floor, pi, sin

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import text
from rasterloom.functions.scalar import FUNCTIONS as fn
from rasterloom.functions.scalar import register_python
from rasterloom.operators.aggregates import hough
from rasterloom.operators.arrangement import escapes
from rasterloom.operators.neighbourhood import oil_paint
from rasterloom.operators.sequential import carved, diffused, labelled
from rasterloom.operators.timeline import SHOW, advanced
from rasterloom.sources.codecs import read_pgm
from rasterloom.streaming.player import playing


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_error_diffusion_keeps_the_mean():
    v = np.tile(np.arange(8) * 36, (8, 1))
    out = diffused(v)
    assert set(np.unique(out)) <= {0, 255} and abs(out.mean() - v.mean()) < 20


def test_a_seam_goes_where_nothing_is():
    v = np.zeros((6, 8), int)
    v[:, 5] = 200
    assert (carved(v, 2).max(axis=0) == 200).sum() == 1 and carved(v, 2).shape == (6, 6)


def test_labels_of_shapes():
    v = np.zeros((8, 8), int)
    v[0:2, 0:2] = v[5, 5] = v[6, 6] = v[0, 7] = 255
    out = labelled(v)
    assert out.max() == 3 and out[0, 0] == 1 and out[0, 7] == 2 and out[5, 5] == out[6, 6] == 3 and out[3, 3] == 0


def test_scalar_functions(spark):
    x = lambda v: F.lit(float(v))
    assert one(spark, fn["clamp"](x(1.25), x(1), x(0))) == 1.0
    assert one(spark, fn["mix"](x(10), x(20), x(1))) == 20.0
    assert one(spark, fn["round"](fn["sin"](x(3.141592653589793 / 2)) * 100)) == 100.0
    assert one(spark, fn["asin"](x(2))) == pytest.approx(1.5707963)
    assert one(spark, fn["trunc"](x(-2.7))) == -2.0 and one(spark, fn["step"](x(1), x(2))) == 0.0
    for bad in (fn["sqrt"](x(-1)), fn["log"](x(0)), fn["divide"](x(1), x(0))):
        with pytest.raises(Exception):
            one(spark, bad)
    register_python(spark, "rl_twice", lambda v: 2 * v)
    assert one(spark, fn["rl_twice"](x(4))) == 8.0


def test_strings(spark):
    s = F.lit
    assert one(spark, text.base64_lenient(s("SGVsbG8=")).cast("string")) == "Hello"
    assert one(spark, text.base64_lenient(s("SGVs!!bG8=")).cast("string")) == "Hel"
    assert bytes(one(spark, text.hex_decoded(s("0x48 65")))) == b"He" and one(spark, text.hex_decoded(s("486"))) is None
    assert one(spark, text.glob(s("a.txt"), "?.t*")) and not one(spark, text.glob(s("axtxt"), "a.txt"))
    assert one(spark, text.split(s("a,b,"), ",")) == ["a", "b"] and one(spark, text.trim(s("\t a b\n"))) == "a b"


def test_gray_maps(spark):
    data = b"P5\n# made by hand\n3 2\n255\n" + bytes([1, 2, 3, 250, 251])
    row = spark.createDataFrame([(data,), (b"BM",)], "d binary").select(*[v.alias(k) for k, v in read_pgm(F.col("d")).items()]).collect()
    assert (row[0].width, row[0].height, row[0].v) == (3, 2, [1, 2, 3, 250, 251, 0]) and row[1].v is None


def test_stream_of_players_is_the_batch(spark, tmp_path):
    rows = [(p, s, 20 + 13 * (s % 5)) for p in range(4) for s in range(6 + 9 * p)]
    ticks = spark.createDataFrame(rows, "player_id long, seq long, dt_ms long")
    ticks.write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks")
    query = playing(stream).writeStream.format("memory").queryName("rl_players").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    found = {r.player_id: (r.frame, r.loops, r.finished) for r in spark.sql("SELECT * FROM rl_players").collect()}
    last = {}
    for r in sorted(advanced(ticks).collect(), key=lambda r: r.seq):
        last[r.player_id] = (r.frame, r.loops, r.finished)
    assert found == last and sum(SHOW) == 275


def test_pgm_headers_have_no_byte_limit(spark):
    body = bytes([1, 2, 3, 250, 251, 0])
    heads = [b"P5\n#" + b"long " * 5000 + b"\n3 2\n255\n", b"P5\n" + b"# one of many\n" * 20000 + b"3 2\n255\n", b"P5 3\n# width\n2 # height\n255\n"]
    rows = spark.createDataFrame([(h + body,) for h in heads], "d binary").select(*[v.alias(k) for k, v in read_pgm(F.col("d")).items()]).collect()
    assert all((r.width, r.height, r.v) == (3, 2, list(body)) for r in rows)


def test_curves_and_matrices_of_spaces(spark):
    from rasterloom.functions import color, spaces

    #: The published matrix from linear sRGB to XYZ for this white point.
    published = ((0.4123908, 0.3575843, 0.1804808), (0.2126390, 0.7151687, 0.0721923), (0.0193308, 0.1191948, 0.9505322))
    assert np.abs(np.array(spaces.to_xyz("srgb")) - np.array(published)).max() < 1e-6
    assert np.abs(np.array(spaces.inverse(spaces.to_xyz("adobe"))) @ np.array(spaces.to_xyz("adobe")) - np.eye(3)).max() < 1e-9
    for cones in spaces.CONES:
        moved = spaces.applied(spaces.adaptation("D65", "D50", cones), spaces.white_xyz("D65"))
        assert moved == pytest.approx(spaces.white_xyz("D50"), abs=1e-6)
    assert spaces.inverse(((1, 2, 3), (2, 4, 6), (0, 0, 1))) == ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    for linear, encoded in spaces.CURVES.values():
        for v in (0.0, 0.002, 0.05, 0.3, 0.7, 1.0):
            assert one(spark, encoded(linear(F.lit(v)))) == pytest.approx(v, abs=2e-5)
    assert one(spark, spaces.CURVES["linear"][0](F.lit(1.5))) == 1.5 and one(spark, spaces.CURVES["pq"][0](F.lit(1.5))) == 1
    # white stays white in every space, and a colour beyond the gamut comes back with its lightness
    for name in spaces.SPACES:
        white = spark.range(1).select(*[c.alias(n) for n, c in zip("rgb", spaces.converted([F.lit(1.0)] * 3, "srgb", name))]).first()
        assert list(white) == pytest.approx([1, 1, 1], abs=2e-3)
    rgb = one(spark, spaces.into_gamut(F.lit(60.0), F.lit(90.0), F.lit(-80.0)))
    assert all(0 <= v <= 1 for v in rgb) and max(rgb) > 0.99
    back = spark.createDataFrame([tuple(rgb)], "r double, g double, b double").select(*[v.alias(n) for n, v in color.lab(F.col("r"), F.col("g"), F.col("b")).items()]).first()
    assert back.l == pytest.approx(60, abs=0.1) and 30 < np.hypot(back.a, back.b) < 121 and back.a / back.b == pytest.approx(-90 / 80, abs=0.02)


def test_delta_e2000_of_published_pairs(spark):
    from rasterloom.functions.color import delta_e2000

    #: Pairs of Lab colours and their distance, from the published test data of the formula.
    pairs = [
        (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
        (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
        (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
        (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
    ]
    df = spark.createDataFrame([tuple(map(float, p)) for p in pairs], "l double, a double, b double, ol double, oa double, ob double, want double")
    for r in df.select("want", delta_e2000({c: F.col(c) for c in "lab"}, {c: F.col(f"o{c}") for c in "lab"}).alias("found")).collect():
        assert r.found == pytest.approx(r.want, abs=1e-4)


def stepped(x0, y0, x1, y1):
    dx, dy, sx, sy, out = abs(x1 - x0), abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1, []
    e = dx - dy
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        e, x0, y0 = e - dy * (2 * e > -dy) + dx * (2 * e < dx), x0 + sx * (2 * e > -dy), y0 + sy * (2 * e < dx)


def test_shapes(spark):
    from rasterloom.operators import drawing

    points = lambda c: [tuple(p) for p in one(spark, c)]
    ends = [(x0, y0, x1, y1) for x0, y0 in ((0, 0), (5, 3), (7, -2)) for x1 in range(-4, 12, 3) for y1 in range(-3, 11, 2)]
    df = spark.createDataFrame(ends, "x0 int, y0 int, x1 int, y1 int")
    for r in df.withColumn("points", drawing.line(*map(F.col, ("x0", "y0", "x1", "y1")))).collect():
        assert [tuple(p) for p in r.points] == stepped(r.x0, r.y0, r.x1, r.y1)
    assert points(drawing.circle(3, 3, 0))[:8] == [(3, 3)] * 8
    for cx, cy, r in ((0, 0, 5), (2, 1, 9)):
        ring = set(points(drawing.circle(cx, cy, r)))
        assert all(abs(((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 - r) < 1 for x, y in ring) and ring <= set(points(drawing.circle(cx, cy, r, True)))
    for rx, ry in ((7, 4), (3, 8), (5, 5)):
        ring = points(drawing.ellipse(0, 0, rx, ry))
        assert {(rx, 0), (-rx, 0), (0, ry), (0, -ry)} <= set(ring)
        assert all(abs(((x / rx) ** 2 + (y / ry) ** 2) ** 0.5 - 1) < 0.25 for x, y in ring)
    assert points(drawing.ellipse_filled(0, 0, 4, 0)) == [(x, 0) for x in range(-4, 5)]
    square = drawing.polygon_of(((0, 0), (4, 0), (4, 4), (0, 4)))
    assert set(points(drawing.polygon(square, True))) == {(x, y) for x in range(5) for y in range(1, 5)}
    assert len(set(points(drawing.polygon(square)))) == 16
    curve = points(drawing.bezier([(0, 7), (3, -4), (7, 6)]))
    assert curve[0] == (0, 7) and curve[-1] == (7, 6) and all(abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1 for a, b in zip(curve, curve[1:]))
    assert points(drawing.bezier([(0, 0), (0, 9), (9, 9), (9, 0)]))[-1] == (9, 0)
    assert len(points(drawing.rectangle(0, 0, 3, 2, True))) == 6


def test_labels_of_a_long_way_and_of_noise():
    def plain(v):
        out, n = np.zeros(v.shape, int), 0
        for y, x in zip(*np.nonzero(v >= 128)):
            if not out[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < v.shape[0] and 0 <= j < v.shape[1] and v[i, j] >= 128 and not out[i, j]:
                        out[i, j] = n
                        todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return out

    snake = np.zeros((61, 61), int)
    snake[::2] = 255
    snake[1::4, -1] = snake[3::4, 0] = 255
    assert labelled(snake).max() == 1
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 31)):
        v = rng.integers(0, 256, shape)
        assert (labelled(v) == plain(v)).all()


def test_headers_that_claim_more_than_the_file_are_null(spark):
    from rasterloom.sources import rasters

    rows = [(1, b"P5 1000000 1000000 255\n"), (2, b"P6 30000 30000 255\nabc"), (3, b"P5 2 1 255\n\x07\x08"), (4, b"P1 99999999999999999999 1\n1"), (5, b"P4 2000 2000\n\xff")]
    got = {r.k: r.im for r in spark.createDataFrame(rows, "k int, d binary").select("k", rasters.netpbm(F.col("d")).alias("im")).collect()}
    assert [got[k] for k in (1, 2, 4, 5)] == [None] * 4 and got[3].v == [7, 8]


def test_colour_seams_are_those_of_gray():
    v = np.random.default_rng(2).integers(0, 256, (12, 14))
    from rasterloom.operators import scenes

    colour = scenes.without_seams(np.repeat(v[None, ..., None], 3, -1).astype(np.float32), 2)
    assert (carved(v, 2) == colour[0, ..., 0]).all()


def test_lines_by_votes_of_images_of_all_sizes_without_a_shuffle(spark):
    rng, rows, want = random.Random(5), [], set()
    for k, (w, h) in enumerate([(8, 8), (5, 3), (1, 7), (8, 8), (6, 1)] * 2):
        v = [rng.choice([0, 127, 128, 255]) for _ in range(w * h)]
        rows.append((k, w, h, v[:-1] if k > 7 else v))  # the last sample may be missing
        on = [(i % w, i // w) for i, s in enumerate(rows[-1][3]) if s > 127]
        votes = Counter((t, floor(abs(d) + 0.5) * (1 if d > 0 else -1)) for t in range(180) for x, y in on for d in [x * round(cos(t * pi / 180), 9) + y * round(sin(t * pi / 180), 9)])
        near = lambda t, r: max(votes[(t + a) % 180, r + b] for a in (-1, 0, 1) for b in (-1, 0, 1))
        found = sorted((-n, t, r) for (t, r), n in list(votes.items()) if n >= 3 and n == near(t, r))
        want |= {(k, t, r, -n, p + 1) for p, (n, t, r) in enumerate(found)}
    lines = hough(spark.createDataFrame([*rows, (99, 8, 8, None)], "image_id long, width int, height int, v array<int>"), 3)
    assert {tuple(r) for r in lines.collect()} == want
    assert "Exchange" not in lines._jdf.queryExecution().toString()


def test_oil_paint_against_loops_on_odd_images(spark):
    rng, rows = random.Random(2), []
    for k, (w, h) in enumerate([(8, 8), (1, 1), (5, 2), (1, 6), (8, 8)]):
        rows.append((k, "r", w, h, [rng.choice([0, 31, 32, 200, 255]) for _ in range(w * h)]))
    frame = spark.createDataFrame([*rows, (9, "r", 0, 0, []), (10, "r", 8, 8, None)], "image_id long, channel string, width int, height int, v array<int>").coalesce(1)
    painted = oil_paint(frame, 2, 8)
    got = {r.image_id: r.v for r in painted.collect()}
    assert got.pop(9) == [] and got.pop(10) is None and len(got) == len(rows)
    for k, _, w, h, v in rows:
        for y in range(h):
            for x in range(w):
                near = [v[j * w + i] for j in range(max(0, y - 2), min(h, y + 3)) for i in range(max(0, x - 2), min(w, x + 3))]
                bins = Counter(t * 8 // 256 for t in near)
                best = min(b for b in bins if bins[b] == max(bins.values()))
                own = [t for t in near if t * 8 // 256 == best]
                assert got[k][y * w + x] == sum(own) // len(own)
    plan = painted._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan


def test_points_escape_as_one_by_one_and_views_of_one_file_are_dealt_out(spark):
    rng = random.Random(4)
    rows = [(k, rng.uniform(-2, 0), rng.uniform(-1, 0), 0.15, *(rng.uniform(-1, 1) if k % 2 else None for _ in "ri")) for k in range(600)]
    found = escapes(spark.createDataFrame(rows, "view_id long, left double, top double, step double, cr double, ci double").coalesce(1), 5, 4, 30)
    got = {(r.view_id, r.x, r.y): r.n for r in found.collect()}
    assert len(got) == 600 * 20
    for k, left, top, step, cr, ci in rows:
        for x in range(5):
            for y in range(4):
                u, v = left + x * step, top + y * step
                (r, i), (c, d), n = ((0.0, 0.0), (u, v), 0) if cr is None else ((u, v), (cr, ci), 0)
                while n < 30 and r * r + i * i <= 4.0:
                    r, i, n = r * r - i * i + c, 2.0 * r * i + d, n + 1
                assert got[k, x, y] == n
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
