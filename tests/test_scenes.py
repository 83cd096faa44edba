"""Whole-image operators against plain loops."""

import math

import numpy as np
import pytest

from rasterloom.operators import scenes

F32 = np.float32


@pytest.fixture(scope="module")
def stack():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:11, 0:13]
    smooth = np.stack([x * 19, y * 22, (x + y) * 10], -1)
    square = np.where(((x > 3) & (x < 9) & (y > 2) & (y < 8))[..., None], 240, 40).repeat(3, -1)
    return np.stack([rng.integers(0, 256, (11, 13, 3)), smooth, square, np.full((11, 13, 3), 7)]).astype(F32)


def close(v, palette):
    if palette == "mono":
        return (0, 0, 0) if int(F32(0.299) * v[0] + F32(0.587) * v[1] + F32(0.114) * v[2]) < 128 else (255, 255, 255)
    if palette == "web":
        return tuple(math.floor(c / 51 + 0.5) * 51 for c in v)
    return min(scenes.PALETTES[palette], key=lambda p: sum((a - b) ** 2 for a, b in zip(p, v)))


@pytest.mark.parametrize("palette", ["mono", "cga", "ega", "web"])
def test_dithering(stack, palette):
    found = scenes.dithered(stack, palette)
    for image, out in zip(stack, found):
        h, w, _ = image.shape
        rest = image.copy()
        for y in range(h):
            for x in range(w):
                chosen = close([int(c) for c in rest[y, x].clip(0, 255)], palette)
                assert tuple(out[y, x]) == chosen
                error = rest[y, x] - np.array(chosen, F32)
                for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                    if y + dy < h and 0 <= x + dx < w:
                        rest[y + dy, x + dx] += error * F32(share) / F32(16)


def test_seams(stack):
    for image, out in zip(stack, scenes.without_seams(stack, 3)):
        for _ in range(3):
            h, w, _ = image.shape
            at = lambda y, x: image[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]  # noqa: B023, E731
            cost = np.array([[np.sqrt(((at(y, x + 1) - at(y, x - 1)) ** 2 + (at(y + 1, x) - at(y - 1, x)) ** 2).sum()) for x in range(w)] for y in range(h)], F32)
            for y in range(1, h):
                for x in range(w):
                    cost[y, x] += min(cost[y - 1, max(x - 1, 0) : x + 2])
            x, rows = int(np.argmin(cost[-1])), []
            for y in range(h - 1, -1, -1):
                rows.insert(0, np.delete(image[y], x, 0))
                if y:
                    x = min((c for c in (x, x - 1, x + 1) if 0 <= c < w), key=lambda c: (cost[y - 1, c], (x, x - 1, x + 1).index(c)))  # noqa: B023
            image = np.stack(rows)
        assert (image == out).all()
    assert scenes.without_seams(stack, 99).shape[2] == 1


def test_edges_of_a_square(stack):
    found = scenes.edges(stack, 60, 160)
    assert not found[3].any() and set(np.unique(found)) <= {0, 255}
    ring = found[2] > 0
    assert ring.any() and not ring[5, 6] and not ring[0].any() and ring[5].sum() in (2, 3, 4)
    # with one bound only strong samples are found, with two also weak ones that touch them
    strong, joined = scenes.edges(stack, 160, 160) > 0, found > 0
    assert (strong <= joined).all()
    reached = strong.copy()
    weak = scenes.edges(stack, 60, 60) > 0
    for _ in range(200):
        reached = weak & np.any([scenes.shifted(reached, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)], 0) | reached
    assert (reached == joined).all()


def test_corners_of_a_square(stack):
    found = scenes.corners(stack, 0.04, 1000)
    assert not found[3].any() and 4 <= found[2].sum() <= 16
    ys, xs = np.nonzero(found[2])
    assert all(min(abs(x - cx) for cx in (3.5, 8.5)) <= 1.5 and min(abs(y - cy) for cy in (2.5, 7.5)) <= 1.5 for x, y in zip(xs, ys))


def test_clusters(stack):
    found = scenes.segmented(stack, 3)
    assert set(map(tuple, found[2].reshape(-1, 3))) == {(240, 240, 240), (40, 40, 40)}
    assert (found[3] == 7).all() and len(set(map(tuple, found[0].reshape(-1, 3)))) <= 3
    points = stack[1].reshape(-1, 3).astype(float)
    step = len(points) // 3
    centres = [points[i * step + step // 2] for i in range(3)]
    for _ in range(10):
        number = [min(range(3), key=lambda c: (((p - centres[c]) ** 2).sum(), c)) for p in points]  # noqa: B023
        new = [points[[n == c for n in number]].mean(0) for c in range(3)]
        moved = max(((a - b) ** 2).sum() for a, b in zip(new, centres)) > 0.1
        centres = new
        if not moved:
            break
    assert (found[1].reshape(-1, 3) == np.trunc([centres[n] for n in number])).all()


def test_two_thresholds(stack):
    levels = np.repeat([[20.0, 100.0, 220.0]], 143 // 3 + 1, 0).reshape(-1)[:143].reshape(1, 11, 13, 1).repeat(3, -1)
    low, high = scenes.two_thresholds(levels.astype(F32))[0]
    assert 20 <= low < 100 <= high < 220
    assert tuple(scenes.two_thresholds(stack)[3]) == (0, 127)
    gray = np.floor(stack[0] @ scenes.LUMA + F32(0.5)).astype(int).ravel()

    def between(a, b):
        parts = [gray[gray <= a], gray[(gray > a) & (gray <= b)], gray[gray > b]]
        return sum(len(p) * (p.mean() - gray.mean()) ** 2 for p in parts) / len(gray) if all(map(len, parts)) else -1

    best = max(between(a, b) for a in range(254) for b in range(a + 1, 255))
    assert between(*scenes.two_thresholds(stack)[0]) == pytest.approx(best, abs=1e-6)


def test_images_of_different_sizes(spark):
    rows = [(1, 2, 1, [0, 200], [0, 200], [0, 200]), (2, 3, 2, [9] * 6, [9] * 6, [9] * 6), (3, 2, 1, [255, 0], [255, 0], [255, 0])]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, r array<int>, g array<int>, b array<int>")
    found = {r.image_id: (r.width, r.height, r.r) for r in scenes.recoloured(df, lambda v: scenes.dithered(v, "mono")).collect()}
    assert found == {1: (2, 1, [0, 255]), 2: (3, 2, [0] * 6), 3: (2, 1, [255, 0])}
    assert scenes.recoloured(df.limit(0), lambda v: v).count() == 0


def at(v, y, x):
    """The sample, or the edge's beyond an edge."""
    return v[min(max(y, 0), v.shape[0] - 1), min(max(x, 0), v.shape[1] - 1)]


def slopes(v):
    """Sobel gradients by loops, 0 at the border."""
    h, w = v.shape
    across, down = np.zeros((h, w)), np.zeros((h, w))
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            across[y, x] = sum((2 - abs(k)) * (v[y + k, x + 1] - v[y + k, x - 1]) for k in (-1, 0, 1))
            down[y, x] = sum((2 - abs(k)) * (v[y + 1, x + k] - v[y - 1, x + k]) for k in (-1, 0, 1))
    return across, down


def test_corners_against_loops(stack):
    for image, found in zip(stack, scenes.corners(stack, 0.04, 1000.0)):
        h, w, _ = image.shape
        across, down = slopes((image @ np.array([0.299, 0.587, 0.114])).astype(float))
        response = np.zeros((h, w))
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                a, b, c = (sum(at(v, y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)) / 9 for v in (across**2, down**2, across * down))
                response[y, x] = a * b - c * c - 0.04 * (a + b) ** 2
        scale = np.abs(response).max() * 1e-4 + 1
        for y in range(h):
            for x in range(w):
                inner = 2 <= y < h - 2 and 2 <= x < w - 2
                most = max(at(response, y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j)
                if not inner or response[y, x] < min(1000.0, most) - scale:
                    assert not found[y, x]
                elif response[y, x] > max(1000.0, most) + scale:
                    assert found[y, x]


def test_edges_against_loops(stack):
    from rasterloom.operators.neighbourhood import KERNELS

    weights, total = KERNELS["gauss5"][:2]
    low, high = 60.0, 160.0
    for image, got in zip(stack, scenes.edges(stack, low, high)):
        h, w, _ = image.shape
        gray = np.trunc(image @ scenes.LUMA).astype(float)
        soft = np.array([[sum(at(gray, y + k // 5 - 2, x + k % 5 - 2) * v for k, v in enumerate(weights)) / total for x in range(w)] for y in range(h)])
        across, down = slopes(soft)
        size = np.hypot(across, down)
        sure, never = np.zeros((h, w), bool), np.ones((h, w), bool)  # ridges that single precision can't sway
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                angle = np.degrees(np.arctan2(-down[y, x], across[y, x])) % 180
                sector = int((angle + 22.5) // 45) % 4
                dx, dy = [(1, 0), (1, 1), (0, 1), (-1, 1)][sector]
                beside = max(at(size, y + dy, x + dx), at(size, y - dy, x - dx))
                edge = abs((angle + 22.5) % 45)
                if min(edge, 45 - edge) > 0.01:
                    sure[y, x], never[y, x] = size[y, x] > beside + 1e-2, size[y, x] < beside - 1e-2
                else:
                    never[y, x] = False
        assert not got[never | (size < low - 1e-2)].any()
        assert (got[sure & (size > high + 1e-2)] == 255).all()
        reached = got == 255
        strong = reached & (size >= high - 1e-2)
        todo = list(zip(*np.nonzero(strong)))
        seen = set(todo)
        while todo:  # all that is shown is joined with something strong
            y, x = todo.pop()
            for j in (-1, 0, 1):
                for i in (-1, 0, 1):
                    n = (y + j, x + i)
                    if 0 <= n[0] < h and 0 <= n[1] < w and reached[n] and n not in seen:
                        seen.add(n)
                        todo.append(n)
        assert len(seen) == reached.sum()
        for y, x in zip(*np.nonzero(sure & (size > low + 1e-2) & ~reached)):  # and what isn't shown stands beside nothing that is
            assert not any(reached[min(max(y + j, 0), h - 1), min(max(x + i, 0), w - 1)] for j in (-1, 0, 1) for i in (-1, 0, 1))
