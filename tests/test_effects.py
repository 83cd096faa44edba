"""Effects on images of odd sizes, against loops over pixels."""

from __future__ import annotations

from math import floor

import numpy as np
import pytest

from rasterloom.operators import effects

F4 = np.float32


def picture(w, h, n=2, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, h, w, 4))


@pytest.mark.parametrize("w, h, grid, clip", [(11, 7, 3, 30.0), (9, 9, 2, 0.0), (16, 5, 4, 200.0)])
def test_tiles_against_loops(w, h, grid, clip):
    stack = picture(w, h)
    got = effects.tile_equalized(grid, clip)(stack)
    hue, sat, light = effects.hsl(stack)
    tw, th = w // grid, h // grid
    for n in range(len(stack)):
        level = [[int(light[n, y, x] * F4(255)) for x in range(w)] for y in range(h)]
        shares = {}
        for ty in range(grid):
            for tx in range(grid):
                counts = [0] * 256
                for y in range(ty * th, (ty + 1) * th):
                    for x in range(tx * tw, (tx + 1) * tw):
                        counts[level[y][x]] += 1
                if clip > 0:
                    limit = int(clip * tw * th / 256)
                    extra = sum(max(0, c - limit) for c in counts)
                    counts = [min(c, limit) + extra // 256 for c in counts]
                shares[ty, tx] = np.cumsum(counts) / (tw * th)
        for y in range(h):
            for x in range(w):
                ax, ay = (x - tw / 2) / tw, (y - th / 2) / th
                bound = lambda v: min(max(v, 0), grid - 1)
                fx, fy = ax - floor(ax), ay - floor(ay)
                new = sum(
                    (fx if i else 1 - fx) * (fy if j else 1 - fy) * shares[bound(floor(ay) + j), bound(floor(ax) + i)][level[y][x]] for i in (0, 1) for j in (0, 1))
                want = effects.from_hsl(hue[n, y, x], sat[n, y, x], F4(min(max(new, 0), 1)))
                assert np.abs(np.array(want) - got[n, y, x, :3]).max() <= 1 and got[n, y, x, 3] == 255


def test_images_smaller_than_the_grid_stay():
    stack = picture(3, 9)
    assert (effects.tile_equalized(4, 2.0)(stack) == stack).all()


def test_lightness_comes_back():
    stack = picture(64, 64, 1)
    back = np.stack(effects.from_hsl(*effects.hsl(stack)), -1)
    assert np.abs(back - stack[..., :3]).max() <= 1


def test_cubes():
    stack = picture(7, 5)
    n = 9
    place = np.arange(n**3)
    same = np.stack([place % n, place // n % n, place // n // n], -1).reshape(n, n, n, 3) * 255 / (n - 1)
    assert np.abs(effects.through_cube(same)(stack) - stack).max() <= 1  # the cube of all colours changes nothing
    two = np.zeros((2, 2, 2, 3))
    two[1, :, :, 0] = 255  # red is what blue was
    assert np.abs(effects.through_cube(two)(stack)[..., 0] - stack[..., 2]).max() <= 1


def test_tables_that_are_no_cube(spark):
    rows = [(k, 1, 2, 3) for k in range(8)]
    frame = lambda r: spark.createDataFrame(r, "place int, r int, g int, b int")
    assert effects.cube_of(frame(rows), 2).shape == (2, 2, 2, 3)
    for bad, size in ((rows[1:], 2), ([*rows, rows[0]], 2), ([rows[1], *rows[1:]], 2), (rows, 66), (rows, 1)):
        with pytest.raises(ValueError):
            effects.cube_of(frame(bad), size)


@pytest.mark.parametrize("dx, dy, blur", [(3, 1, 2.0), (-2, 0, 0.7), (0, -4, 0.0)])
def test_shadows_against_loops(dx, dy, blur):
    stack = picture(5, 3, 1)
    got = effects.shadowed(dx, dy, blur, 0.8, (9, 8, 7))(stack)[0]
    pad = max(0, -int(-blur * 3 // 1))
    w, h = 5 + abs(dx) + 2 * pad, 3 + abs(dy) + 2 * pad
    assert got.shape == (h, w, 4)
    shade = np.zeros((h, w, 4), int)
    x0, y0 = pad + max(0, -dx), pad + max(0, -dy)
    for y in range(3):
        for x in range(5):
            shade[y0 + dy + y, x0 + dx + x] = (9, 8, 7, int(F4(stack[0, y, x, 3]) / F4(255) * F4(0.8) * F4(255)))
    if blur > 0.5:
        for axis in (1, 0):
            r, before, size = int(blur), shade.copy(), shade.shape[axis]
            for k in range(size):
                part = before.take(range(max(0, k - r), min(size, k + r + 1)), axis)
                shade[(slice(None), k) if axis else k] = part.sum(axis) // part.shape[axis]
    for y in range(h):
        for x in range(w):
            if not (0 <= y - y0 < 3 and 0 <= x - x0 < 5):
                assert got[y, x].tolist() == shade[y, x].tolist()
            else:
                top, low = stack[0, y - y0, x - x0], shade[y, x]
                a, b = top[3] / 255, low[3] / 255
                out = a + b * (1 - a)
                want = [*((top[:3] * a + low[:3] * b * (1 - a)) / out), out * 255] if out > 0 else [0] * 4
                assert np.abs(got[y, x] - np.array(want)).max() <= 1.001


@pytest.mark.parametrize("pattern", ["dot", "line", "cross"])
def test_screens_with_cells_cut_at_the_edge(pattern):
    stack = picture(7, 10, 1)
    got = effects.screened(pattern, 4, 0.0)(stack)[0]
    for y in range(10):
        for x in range(7):
            cy, cx = y // 4 * 4, x // 4 * 4
            cell = stack[0, cy : cy + 4, cx : cx + 4, :3]
            dark = 1 - np.trunc(cell @ [0.299, 0.587, 0.114] + 1e-4).mean() / 255
            dx, dy = abs(x - cx - 2), abs(y - cy - 2)
            size = {"dot": (dx * dx + dy * dy) ** 0.5 / 2, "line": dy, "cross": min(dx, dy)}[pattern]
            if abs(size - dark) > 1e-3:
                assert (got[y, x, 0] == 0) == (size <= dark and dark > 0.05)
                assert got[y, x, 3] == (stack[0, y, x, 3] if got[y, x, 0] == 0 else 255)


def test_mirrors_are_symmetric():
    stack = picture(40, 40, 1)
    got = effects.mirrored(4)(stack)[0]
    assert (got[1:, 1:] == got[1:, 1:][::-1]).mean() > 0.95 and (got[1:, 1:] == got[1:, 1:][:, ::-1]).mean() > 0.95


def test_stacks_stay_small_however_long_batches_are(spark):
    def seen(stack):
        assert len(stack) <= 256 and stack[..., 0].size <= max(1 << 20, stack[0, ..., 0].size)
        return 255 - stack

    names = "image_id, width, height, r, g, b, a".split(", ")
    rows = [(k, w, 2, *[[k % 256] * w * 2] * 4) for k in range(1200) for w in [2 + k % 2]]
    frame = spark.createDataFrame(rows, effects.SCHEMA).coalesce(1).select(*names)
    got = {r.image_id: (r.width, list(r.b)) for r in effects.over_stacks(frame, seen).collect()}
    assert got == {k: (2 + k % 2, [255 - k % 256] * (2 + k % 2) * 2) for k in range(1200)}
