"""Projections, mosaics and formats on images of odd sizes, against loops over pixels."""

from __future__ import annotations

from math import cos, floor, radians, sin, tan

import numpy as np
import pytest

from rasterloom.operators import conversions as c


def picture(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (1, h, w, 4))


@pytest.mark.parametrize("turn", [(0.0, 0.0, 0.0), (25.0, 0.0, 0.0), (-30.0, 20.0, 70.0), (90.0, 0.0, 0.0)])
def test_perspective(turn):
    w, h, view, distance = 9, 7, 60.0, 8.0
    stack = picture(w, h)
    got = c.turned_in_space(*turn, view, distance)(stack)[0]
    (cy, sy), (cp, sp), (cr, sr) = ((cos(radians(v)), sin(radians(v))) for v in turn)
    m = [[cy * cr - sy * sp * sr, -cy * sr - sy * sp * cr, -sy * cp], [cp * sr, cp * cr, -sp], [sy * cr + cy * sp * sr, -sy * sr + cy * sp * cr, cy * cp]]
    focus, shown = (w / 2) / tan(radians(view) / 2), 0
    for y in range(h):
        for x in range(w):
            sx, sy_ = x - w / 2, y - h / 2
            below = m[0][2] * sx + m[1][2] * sy_ + m[2][2] * focus
            want = [0, 0, 0]
            if abs(below) >= 1e-5 and (t := m[2][2] * distance / below) >= 0:
                ray = (t * sx, t * sy_, t * focus - distance)
                u, v = (round(sum(m[i][k] * ray[i] for i in range(3)) + half, 6) for k, half in ((0, w / 2), (1, h / 2)))
                if 0 <= u < w - 1 and 0 <= v < h - 1:
                    i, j = floor(u), floor(v)
                    a, b = u - i, v - j
                    p = stack[0, :, :, :3]
                    want = (1 - a) * (1 - b) * p[j, i] + a * (1 - b) * p[j, i + 1] + (1 - a) * b * p[j + 1, i] + a * b * p[j + 1, i + 1]
                    shown += 1
            assert np.abs(got[y, x, :3] - np.array(want)).max() < 1 + 1e-5 and got[y, x, 3] == 255
    assert shown or turn[0] == 90


def test_mosaics_with_cells_cut_at_the_edge():
    stack = picture(11, 6)
    got = c.in_characters(4, 5)(stack)[0]
    for y in range(6):
        for x in range(11):
            cell = stack[0, y // 5 * 5 : y // 5 * 5 + 5, x // 4 * 4 : x // 4 * 4 + 4, :3]
            mean = np.trunc(cell @ [0.299, 0.587, 0.114] + 1e-4).mean()
            lit = c.CHARACTERS[min(9, int(mean / 255 * 9))][y % 5 * 8 // 5] >> (7 - x % 4 * 8 // 4) & 1
            assert got[y, x].tolist() == [255 if lit else 0] * 3 + [255]


def test_filter_by_colour_keeps_flat_images():
    flat = np.full((1, 4, 5, 4), 77)
    assert (c.near_in_colour(2, 1.0, 10.0)(flat)[..., :3] == 77).all()


def test_three_levels_and_formats(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 90), (1, 2, 0, 91), (1, 3, 0, 255)], "image_id long, x int, y int, v int")
    got = c.three_levels(px, spark.createDataFrame([(1, 5, 90)], "image_id long, low int, high int")).orderBy("x").collect()
    assert [r.v for r in got] == [0, 128, 255, 255]
    back = c.converted(c.converted(px, "rgba"), "gray").orderBy("x").collect()
    assert [abs(r.v - v) <= 1 for r, v in zip(back, (5, 90, 91, 255))] == [True] * 4
    assert c.converted(px, "rgb").columns == ["image_id", "x", "y", "r", "g", "b"]
    with pytest.raises(ValueError):
        c.converted(px, "cmyk")
