"""Operators that look at a colour image as a whole: palette dithering, seams, edges, corners, clusters, two thresholds.

An image is a row with width, height and an array for each channel.  Arrow batches of images are worked on together:
images of one size are stacked, so that steps that depend on one another (a pixel on those before it, a row on the
one above) are taken once for the whole stack.  Nothing is shuffled; an image must fit into a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import images, quilts, stacks

#: The palettes of dithering.
PALETTES = {
    "cga": ((0, 0, 0), (0, 255, 255), (255, 0, 255), (255, 255, 255)),
    "ega": (
        (0, 0, 0), (0, 0, 170), (0, 170, 0), (0, 170, 170), (170, 0, 0), (170, 0, 170), (170, 85, 0), (170, 170, 170),
        (85, 85, 85), (85, 85, 255), (85, 255, 85), (85, 255, 255), (255, 85, 85), (255, 85, 255), (255, 255, 85), (255, 255, 255),
    ),
}
#: Weights of luma.
LUMA = np.array([0.299, 0.587, 0.114], np.float32)


def colour_images(s, d) -> DataFrame:
    """image_id, width, height, r, g, b of the table's images; green and blue are red's samples moved on."""
    turn = lambda k: F.concat(F.slice("v", k + 1, 64), F.slice("v", 1, k))
    return images(s, d).select("image_id", "width", "height", F.col("v").alias("r"), turn(21).alias("g"), turn(42).alias("b"))


def whole_colours(planes: DataFrame) -> DataFrame:
    """Rows for each channel (as those of neighbourhood filters) brought together into one for each image."""
    of = lambda c: F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c)
    return planes.groupBy("image_id", "width", "height").agg(*[of(c) for c in "rgb"])


def stacked(df: DataFrame, of: Callable[[np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """of(stack of images x height x width x 3) gives columns, a value for each image; image_id comes first."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, h, some in stacks(parts):
            stack = np.stack([np.stack(some[c].to_list()) for c in "rgb"], -1).reshape(len(some), h, w, 3)
            yield pd.DataFrame({"image_id": some["image_id"].to_list()} | of(stack.astype(np.float32)))

    return df.select("image_id", "width", "height", "r", "g", "b").mapInPandas(run, "image_id long, " + schema)


def nearest(colours: np.ndarray, palette: str) -> np.ndarray:
    """The palette's colours for n whole colours of 0 to 255; of equals the first."""
    if palette == "mono":
        return np.where(np.floor(colours @ LUMA) < 128, 0, 255)[:, None].repeat(3, 1)
    if palette == "web":
        return np.floor(colours / 51 + 0.5) * 51
    entries = np.array(PALETTES[palette])
    return entries[((colours[:, None] - entries) ** 2).sum(-1).argmin(1)]


def dithered(stack: np.ndarray, palette: str) -> np.ndarray:
    """Error diffusion in raster order, in single precision; errors are those of what hasn't been clamped."""
    n, h, w, _ = stack.shape
    rest = np.zeros((n, h + 1, w + 2, 3), np.float32)
    rest[:, :h, 1 : w + 1] = stack
    out = np.zeros(stack.shape, np.int32)
    for y in range(h):
        for x in range(1, w + 1):
            own = rest[:, y, x]
            out[:, y, x - 1] = chosen = nearest(np.trunc(own.clip(0, 255)), palette)
            error = own - chosen.astype(np.float32)
            for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                rest[:, y + dy, x + dx] += error * np.float32(share) / np.float32(16)
    return out


def without_seams(stack: np.ndarray, seams: int) -> np.ndarray:
    """Narrower by seams of least energy (the size of the colour's change across and down), found from the top.

    Of equals the leftmost end; on the way up straight before left before right.
    """
    for _ in range(min(seams, stack.shape[2] - 1)):
        n, h, w, _ = stack.shape
        wide, high = np.pad(stack, ((0, 0), (0, 0), (1, 1), (0, 0)), "edge"), np.pad(stack, ((0, 0), (1, 1), (0, 0), (0, 0)), "edge")
        cost = np.sqrt(((wide[:, :, 2:] - wide[:, :, :-2]) ** 2 + (high[:, 2:] - high[:, :-2]) ** 2).sum(-1))
        for y in range(1, h):
            above = np.pad(cost[:, y - 1], ((0, 0), (1, 1)), constant_values=np.inf)
            cost[:, y] += np.minimum(np.minimum(above[:, 1:-1], above[:, :-2]), above[:, 2:])
        keep, each = np.ones((n, h, w), bool), np.arange(n)
        x = cost[:, -1].argmin(1)
        for y in range(h - 1, -1, -1):
            keep[each, y, x] = False
            if y:
                above = np.pad(cost[:, y - 1], ((0, 0), (1, 1)), constant_values=np.inf)
                ways = np.stack([above[each, x + 1], above[each, x], above[each, x + 2]])
                x = x + np.array([0, -1, 1])[ways.argmin(0)]
        stack = stack[keep].reshape(n, h, w - 1, stack.shape[-1])
    return stack


def shifted(stack: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The neighbour at (dx, dy) of each sample; beyond an edge, the edge's."""
    h, w = stack.shape[1:3]
    return stack[:, np.arange(h).__add__(dy).clip(0, h - 1)][:, :, np.arange(w).__add__(dx).clip(0, w - 1)]


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients to the right and down; 0 at the border."""
    at = lambda dx, dy: shifted(gray, dx, dy)
    across = sum(((at(1, dy) - at(-1, dy)) * np.float32(2 - abs(dy)) for dy in (-1, 0, 1)))
    down = sum(((at(dx, 1) - at(dx, -1)) * np.float32(2 - abs(dx)) for dx in (-1, 0, 1)))
    for g in (across, down):
        g[:, [0, -1]] = 0
        g[:, :, [0, -1]] = 0
    return across, down


def edges(stack: np.ndarray, low: float, high: float) -> np.ndarray:
    """Blurred luminance, gradients, their ridges, and what of these is strong or joined with what is: 255, else 0."""
    from .neighbourhood import KERNELS

    gray = np.trunc(stack @ LUMA)
    weights = np.array(KERNELS["gauss5"][0], np.float32) / np.float32(KERNELS["gauss5"][1])
    soft = sum(shifted(gray, k % 5 - 2, k // 5 - 2) * w for k, w in enumerate(weights))
    across, down = sobel(soft)
    size = np.hypot(across, down)
    angle = np.degrees(np.arctan2(-down, across))
    sector = np.floor((np.where(angle < 0, angle + 180, angle) + 22.5) / 45).astype(int) % 4
    beside = [(1, 0), (1, 1), (0, 1), (-1, 1)]
    ridge = np.zeros(size.shape, bool)
    for k, (dx, dy) in enumerate(beside):
        ridge |= (sector == k) & (size >= shifted(size, dx, dy)) & (size >= shifted(size, -dx, -dy))
    ridge[:, [0, -1]] = False
    ridge[:, :, [0, -1]] = False
    found, weak = ridge & (size >= high), ridge & (size >= low)
    while True:  # one step in all directions, until nothing is reached
        more = weak & np.any([shifted(found, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)], 0)
        if (more <= found).all():
            return np.where(found, 255, 0)
        found = found | more


def corners(stack: np.ndarray, k: float, threshold: float) -> np.ndarray:
    """Where the corner response is over the threshold and no neighbour's is higher, two samples and more from the border."""
    across, down = sobel(stack @ LUMA)
    mean = lambda v: sum(shifted(v, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) / np.float32(9)
    a, b, c = mean(across * across), mean(down * down), mean(across * down)
    response = a * b - c * c - np.float32(k) * (a + b) * (a + b)
    response[:, [0, -1]] = 0
    response[:, :, [0, -1]] = 0
    most = np.max([shifted(response, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)], 0)
    found = (response > threshold) & (response >= most)
    found[:, [0, 1, -2, -1]] = False
    found[:, :, [0, 1, -2, -1]] = False
    return found


def segmented(stack: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Every pixel in the mean colour of its cluster; centres begin at evenly spaced pixels, and of equals the first is nearest."""
    n, h, w, _ = stack.shape
    points = stack.reshape(n, h * w, 3).astype(np.float64)
    step = h * w // clusters
    centres = points[:, np.minimum(np.arange(clusters) * step + step // 2, h * w - 1)].copy()
    busy = np.ones(n, bool)
    number = np.zeros((n, h * w), int)
    for _ in range(rounds):
        apart = ((points[busy][:, :, None] - centres[busy][:, None]) ** 2).sum(-1)
        number[busy] = apart.argmin(-1)
        member = number[busy][:, :, None] == np.arange(clusters)
        count = member.sum(1)
        mean = np.einsum("npk,npc->nkc", member, points[busy]) / np.maximum(count, 1)[:, :, None]
        new = np.where(count[:, :, None] > 0, mean, centres[busy])
        moved = (((new - centres[busy]) ** 2).sum(-1) > 0.1).any(1)
        centres[busy] = new
        busy[np.flatnonzero(busy)[~moved]] = False
        if not busy.any():
            break
    return np.trunc(centres[np.arange(n)[:, None], number].clip(0, 255)).reshape(stack.shape)


def two_thresholds(stack: np.ndarray) -> np.ndarray:
    """The two gray levels that part three classes best, by the variance between them; the first of equals; else (0, 127)."""
    gray = np.floor(stack @ LUMA + np.float32(0.5)).astype(int).clip(0, 255).reshape(len(stack), -1)
    out = []
    for v in gray:
        share = np.bincount(v, minlength=256) / v.size
        weight, mass = np.cumsum(share), np.cumsum(share * np.arange(256))
        first, second = np.meshgrid(np.arange(254), np.arange(255), indexing="ij")
        w0, w1 = weight[first], weight[second] - weight[first]
        w2, m0, m1 = 1 - weight[second], mass[first], mass[second] - mass[first]
        m2 = mass[-1] - mass[second]
        good = (second > first) & (w0 > 1e-12) & (w1 > 1e-12) & (w2 > 1e-12)
        part = lambda w, m: np.divide(m, w, where=good, out=np.zeros(w.shape)) - mass[-1]
        between = np.where(good, w0 * part(w0, m0) ** 2 + w1 * part(w1, m1) ** 2 + w2 * part(w2, m2) ** 2, -1).round(9)
        out.append(np.unravel_index(between.argmax(), between.shape) if good.any() else (0, 127))
    return np.array(out)


def colours(of) -> Callable[[np.ndarray], dict[str, list]]:
    def columns(stack: np.ndarray) -> dict[str, list]:
        out = of(stack).astype(np.int32)
        return {"width": [out.shape[2]] * len(out), "height": [out.shape[1]] * len(out)} | {c: list(out[..., k].reshape(len(out), -1)) for k, c in enumerate("rgb")}

    return columns


COLOURS = "width int, height int, r array<int>, g array<int>, b array<int>"


def recoloured(df: DataFrame, of) -> DataFrame:
    """of(stack) as channels: image_id, width, height, r, g, b."""
    return stacked(df, colours(of), COLOURS)


def colour_pixels(df: DataFrame) -> DataFrame:
    return df.select("image_id", "width", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "c")).select(
        "image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "c.r", "c.g", "c.b")


def plane(df: DataFrame, of) -> DataFrame:
    """of(stack) as one channel: image_id, v."""
    return stacked(df, lambda s: {"v": list(of(s).astype(np.int32).reshape(len(s), -1))}, "v array<int>")


def corner_rows(df: DataFrame, k: float, threshold: float) -> DataFrame:
    """image_id, x, y of each corner."""
    rows = stacked(df, lambda s: {"at": [[{"x": int(x), "y": int(y)} for y, x in zip(*np.nonzero(m))] for m in corners(s, k, threshold)]}, "at array<struct<x: int, y: int>>")
    return rows.select("image_id", F.explode("at").alias("p")).select("image_id", "p.x", "p.y")


OPS = {
    **{f"dither_{p}": (lambda s, d, p=p: colour_pixels(recoloured(colour_images(s, d), lambda v: dithered(v, p))), None) for p in ("mono", "cga", "ega", "web")},
    "seam_carve_colour": (lambda s, d: colour_pixels(recoloured(whole_colours(quilts(s, d)), lambda v: without_seams(v, 4))), None),
    "canny_edges": (lambda s, d: plane(colour_images(s, d), lambda v: edges(v, 60.0, 160.0)), None),
    "harris_corners": (lambda s, d: corner_rows(colour_images(s, d), 0.04, 1000.0), None),
    "k_means": (lambda s, d: colour_pixels(recoloured(colour_images(s, d), lambda v: segmented(v, 4))), None),
    "multi_otsu": (lambda s, d: stacked(colour_images(s, d), lambda v: dict(zip(("low", "high"), two_thresholds(v).T.tolist())), "low int, high int"), None),
}
