"""Formats converted, parts of images blended through masks, filters by colour, projections, mosaics of characters, three levels."""

from __future__ import annotations

from math import cos, radians, sin, tan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blend
from ..oracle import LUMA, PX, byte as sql_byte, f, pick
from ..sources.tables import KEY, byte, gray, luma, pixels
from .compositing import _sql_blend, sides
from .effects import F4, _op
from .scenes import colour_images, stacked, two_thresholds

FORMATS = ("gray", "rgb", "rgba")


def converted(df: DataFrame, to: str) -> DataFrame:
    """Pixels (KEY, and v, or r, g, b and maybe a) in another format: gray is the truncated luma, alpha that isn't there is 255."""
    if to not in FORMATS:
        raise ValueError(f"unknown format {to}")
    one = "v" in df.columns
    if to == "gray":
        return df.select(*KEY, F.col("v") if one else byte(luma()).alias("v"))
    colours = [F.col("v").alias(c) if one else F.col(c) for c in "rgb"]
    alpha = F.col("a") if "a" in df.columns else F.lit(255)
    return df.select(*KEY, *colours, *([alpha.alias("a")] if to == "rgba" else []))


def rectangle_over(df: DataFrame, source: tuple[int, int, int, int], at: tuple[int, int], mode: str, opacity: float, mask: str | None = None) -> DataFrame:
    """A rectangle (x, y, width, height) of the next image over this one at a place; what lies outside of either is left out.

    mask: a channel of the next image whose samples are shares of its alpha.
    """
    x, y, width, height = source
    alpha = F.floor((F.col("a") * F.col(mask) + 127) / 255).cast("int") if mask else F.col("a")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    part = df.filter(inside).select((F.col("image_id") - 1).alias("image_id"), (F.col("x") - x + at[0]).alias("x"), (F.col("y") - y + at[1]).alias("y"), *[F.col(c).alias(f"t_{c}") for c in "rgb"], alpha.alias("t_a"))
    joined = df.join(part, KEY, "left")
    base, top = sides(joined)
    mixed = blend.over(mode, base, {k: F.coalesce(v, F.lit(0)) for k, v in top.items()}, opacity)
    own = F.struct(*[base[k].cast("int").alias(k) for k in "rgba"])
    return joined.select(*KEY, F.when(F.col("t_a").isNull(), own).otherwise(mixed).alias("o")).select(*KEY, "o.*")


def near_in_colour(reach: int, sigma_place: float, sigma_colour: float):
    """Means of the neighbours by how near they are in place and in colour; beyond an edge, the edge's.  Alpha becomes 255."""

    def of(stack: np.ndarray) -> np.ndarray:
        h, w = stack.shape[1:3]
        own = stack[..., :3].astype(np.float64)
        total, weight = np.zeros(own.shape), np.zeros((*own.shape[:3], 1))
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                other = own[:, (np.arange(h) + dy).clip(0, h - 1)][:, :, (np.arange(w) + dx).clip(0, w - 1)]
                apart = ((own - other) ** 2).sum(-1, keepdims=True)
                share = np.exp(-(dx * dx + dy * dy) / (2 * sigma_place**2)) * np.exp(-apart / (2 * sigma_colour**2))
                total, weight = total + other * share, weight + share
        return np.concatenate([np.trunc((total / weight).round(6)), np.full((*own.shape[:3], 1), 255)], -1)

    return of


def turned_in_space(yaw: float, pitch: float, roll: float, view: float, distance: float):
    """The image on a plane that is turned (degrees) about its centre, seen from `distance` with a field of view of `view` degrees.

    Each sample looks back along its ray to the plane and is mixed from the four samples there; black where there are none.
    """
    (cy, sy), (cp, sp), (cr, sr) = ((cos(radians(v)), sin(radians(v))) for v in (yaw, pitch, roll))
    m = np.array([
        [cy * cr - sy * sp * sr, -cy * sr - sy * sp * cr, -sy * cp],
        [cp * sr, cp * cr, -sp],
        [sy * cr + cy * sp * sr, -sy * sr + cy * sp * cr, cy * cp],
    ])

    def of(stack: np.ndarray) -> np.ndarray:
        _, h, w, _ = stack.shape
        y, x = np.mgrid[:h, :w].astype(float)
        x, y, depth = x - w / 2, y - h / 2, (w / 2) / tan(radians(view / 2))
        below = m[0, 2] * x + m[1, 2] * y + m[2, 2] * depth
        seen = np.abs(below) >= 1e-5
        t = m[2, 2] * distance / np.where(seen, below, 1)
        ray = [t * x, t * y, t * depth - distance]
        at_x, at_y = (sum(m[i, k] * ray[i] for i in range(3)) + half for k, half in ((0, w / 2), (1, h / 2)))
        at_x, at_y = at_x.round(6), at_y.round(6)
        seen &= (t >= 0) & (at_x >= 0) & (at_x < w - 1) & (at_y >= 0) & (at_y < h - 1)
        u, v = (np.floor(np.where(seen, a, 0)).astype(int) for a in (at_x, at_y))
        fx, fy = (np.where(seen, a, 0) - k for a, k in ((at_x, u), (at_y, v)))
        near = lambda i, j: stack[:, np.minimum(v + j, h - 1), np.minimum(u + i, w - 1), :3]
        fx, fy = fx[..., None], fy[..., None]
        mixed = (1 - fx) * (1 - fy) * near(0, 0) + fx * (1 - fy) * near(1, 0) + (1 - fx) * fy * near(0, 1) + fx * fy * near(1, 1)
        out = np.where(seen[..., None], np.trunc(mixed.round(6)), 0)
        return np.concatenate([out, np.full((*out.shape[:3], 1), 255)], -1)

    return of


#: The ten characters of mosaics, from dark to light, as rows of eight bits.
CHARACTERS = (
    (0, 0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 24, 24, 0, 0), (0, 24, 24, 0, 24, 24, 0, 0), (0, 0, 0, 126, 126, 0, 0, 0), (24, 24, 24, 126, 126, 24, 24, 24),
    (0, 126, 0, 126, 0, 126, 0, 0), (66, 36, 24, 24, 24, 24, 36, 66), (60, 66, 66, 66, 66, 66, 66, 60), (60, 66, 66, 60, 60, 66, 66, 60), (126, 255, 255, 255, 255, 255, 255, 126),
)


def in_characters(width: int, height: int):
    """Cells as the character of their mean luma, white on black; alpha is 255."""
    bits = np.unpackbits(np.array(CHARACTERS, np.uint8), axis=1).reshape(10, 8, 8).astype(bool)

    def of(stack: np.ndarray) -> np.ndarray:
        _, h, w, _ = stack.shape
        level = np.trunc(F4(0.299) * stack[..., 0].astype(F4) + F4(0.587) * stack[..., 1].astype(F4) + F4(0.114) * stack[..., 2].astype(F4)).astype(np.int64)
        rows, columns = np.arange(0, h, height), np.arange(0, w, width)
        sums = np.add.reduceat(np.add.reduceat(level, rows, 1), columns, 2)
        count = np.minimum(height, h - rows)[:, None] * np.minimum(width, w - columns)
        mean = sums.astype(F4) / count.astype(F4)
        kind = np.minimum((mean / F4(255) * F4(9)).astype(int), 9)
        wide = lambda v: v.repeat(height, 1)[:, :h].repeat(width, 2)[:, :, :w]
        lit = bits[wide(kind), (np.arange(h) % height * 8 // height)[:, None], np.arange(w) % width * 8 // width]
        shade = np.where(lit, 255, 0)
        return np.stack([shade, shade, shade, np.full(shade.shape, 255)], -1)

    return of


def three_levels(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Gray pixels as 0 up to the lower of two levels (image_id, low, high), 128 up to the higher, else 255; one row of levels for each image."""
    return df.join(thresholds, "image_id").select(*KEY, F.when(F.col("v") <= F.col("low"), 0).when(F.col("v") <= F.col("high"), 128).otherwise(255).alias("v"))


def levels_of(s, d) -> DataFrame:
    return stacked(colour_images(s, d), lambda v: dict(zip(("low", "high"), two_thresholds(v).T.tolist())), "low int, high int")


_RECT_JOIN = "FROM px p LEFT JOIN (SELECT image_id - 1 AS image_id, x - 1 + 3 AS x, y - 2 - 1 AS y, r, g, b, a FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 7) q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y"
_NEAR = f"""{PX}, k AS (SELECT dx, dy FROM unnest(range(-1, 2)) AS a(dx), unnest(range(-1, 2)) AS b(dy)),
s AS (SELECT p.image_id, p.x, p.y, q.r, q.g, q.b, exp(-(dx * dx + dy * dy) / CAST(4.5 AS DOUBLE)) * exp(-((p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b)) / CAST(12800 AS DOUBLE)) AS w
  FROM px p, k JOIN px q ON q.image_id = p.image_id AND q.x = greatest(0, least(7, p.x + dx)) AND q.y = greatest(0, least(7, p.y + dy)))
SELECT image_id, x, y, {', '.join(f'CAST(trunc(round(sum({c} * w) / sum(w), 6)) AS INTEGER) AS {c}' for c in 'rgb')}, 255 AS a FROM s GROUP BY image_id, x, y"""


def _characters_sql(width: int, height: int) -> str:
    rows = ", ".join(f"({k}, {y}, {v})" for k, c in enumerate(CHARACTERS) for y, v in enumerate(c))
    lit = f"(c.v >> (7 - x % {width} * 8 // {width})) & 1 = 1"
    return f"""{PX}, ch(k, row_no, v) AS (VALUES {rows}), lu AS (SELECT *, {sql_byte(LUMA)} AS l FROM px),
me AS (SELECT *, {f('sum(l) OVER w')} / {f('count(*) OVER w')} AS mean FROM lu WINDOW w AS (PARTITION BY image_id, x // {width}, y // {height})),
ki AS (SELECT *, least(9, CAST(trunc(mean / {f(255)} * {f(9)}) AS INTEGER)) AS kind FROM me)
SELECT image_id, x, y, {', '.join(f'CASE WHEN {lit} THEN 255 ELSE 0 END AS {c}' for c in 'rgb')}, 255 AS a FROM ki JOIN ch c ON c.k = kind AND c.row_no = y % {height} * 8 // {height}"""


OPS = {
    "convert_to_gray": (lambda s, d: converted(pixels(s, d), "gray"), pick(f"image_id, x, y, {sql_byte(LUMA)} AS v")),
    "convert_to_rgb": (lambda s, d: converted(pixels(s, d), "rgb"), pick("image_id, x, y, r, g, b")),
    "convert_gray_to_rgba": (lambda s, d: converted(gray(s, d), "rgba"), pick("image_id, x, y, v AS r, v AS g, v AS b, 255 AS a", "gr")),
    "blend_rect": (lambda s, d: rectangle_over(pixels(s, d), (1, 2, 5, 9), (3, -1), "overlay", 0.6), _sql_blend("overlay", 0.6, _RECT_JOIN, "q.a IS NULL OR ")),
    "blend_rect_masked": (lambda s, d: rectangle_over(pixels(s, d), (1, 2, 5, 9), (3, -1), "multiply", 0.9, "g"), _sql_blend("multiply", 0.9, _RECT_JOIN, "q.a IS NULL OR ").replace("(q.a / CAST", "(((q.a * q.g + 127) // 255) / CAST")),
    "bilateral_by_colour": (_op(near_in_colour(1, 1.5, 80.0)), _NEAR),
    "perspective": (_op(turned_in_space(20.0, -10.0, 15.0, 60.0, 9.0)), None),
    "character_mosaic": (_op(in_characters(4, 4)), _characters_sql(4, 4)),
    "three_levels": (lambda s, d: three_levels(gray(s, d), levels_of(s, d)), None),
}
