"""Filters over a pixel's neighbourhood, and changes of geometry.

A channel of an image (or of a tile of one, with its halo) is a row that holds width, height and an array of
samples, row by row; images of any sizes and channels of any number stand in one table.  A result sample is, but for
oil painting, an expression over a fixed number of taps, so an image is filtered where it lies: one narrow stage, no shuffle, and
no join of pixels with their neighbours.  Work grows with samples times taps; images spread over tasks as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil, cos, exp, radians, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..oracle import QUILTS, PX, byte as sql_byte, f, pick
from ..sources.tables import byte, f32, images, quilts, stacks

#: Weights row by row, divisor, offset.
KERNELS = {
    "gauss5": ((2, 4, 5, 4, 2, 4, 9, 12, 9, 4, 5, 12, 15, 12, 5, 4, 9, 12, 9, 4, 2, 4, 5, 4, 2), 159, 0),
    "box3": ((1, 1, 1, 1, 1, 1, 1, 1, 1), 9, 0),
    "sharpen": ((0, -1, 0, -1, 5, -1, 0, -1, 0), 1, 0),
    "sobel_x": ((-1, 0, 1, -2, 0, 2, -1, 0, 1), 1, 128),
    "sobel_y": ((-1, -2, -1, 0, 0, 0, 1, 2, 1), 1, 128),
    "laplacian": ((0, 1, 0, 1, -4, 1, 0, 1, 0), 1, 128),
    "emboss": ((-2, -1, 0, -1, 1, 1, 0, 1, 2), 1, 128),
}


def width() -> Column:
    return F.col("width")


def height() -> Column:
    return F.col("height")


def clamp(value: Column, most: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), most)


def x_of(i: Column, w: Column | None = None) -> Column:
    return i % (width() if w is None else w)


def y_of(i: Column, w: Column | None = None) -> Column:
    return F.floor(i / (width() if w is None else w)).cast("int")


def tap(v: Column, i: Column, dx: int, dy: int) -> Column:
    """The sample beside place i; beyond an edge, the edge's."""
    return F.get(v, clamp(y_of(i) + dy, height() - 1) * width() + clamp(x_of(i) + dx, width() - 1))


def inside(i: Column, dx: int, dy: int) -> Column:
    x, y = x_of(i) + dx, y_of(i) + dy
    return (x >= 0) & (x < width()) & (y >= 0) & (y < height())


def square(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def total(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def mapped(df: DataFrame, of: Callable[[Column, Column], Column], w: Column | None = None, h: Column | None = None) -> DataFrame:
    """of(v, i) for each place i of the result, in place of v; w and h: the result's size if it isn't the image's.

    v is bound by an outer lambda, so that the optimizer can't put its own computation in the place of each tap.  An
    image without samples stays as it is; one whose samples aren't width times height is an error.
    """
    n = (width() if w is None else w) * (height() if h is None else h)
    whole = lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: of(v, i))
    wrong = F.raise_error(F.concat(F.lit("an image's samples aren't its width times its height: "), F.size("v").cast("string")))
    checked = F.when(F.size("v") == width() * height(), F.col("v")).otherwise(wrong.cast("array<int>"))
    found = df.withColumn("v", F.when((F.size("v") == 0) | (n <= 0), F.array().cast("array<int>")).otherwise(F.get(F.transform(F.array(checked), whole), F.lit(0))))
    return found if w is None else found.withColumns({"width": w.cast("int"), "height": h.cast("int")})


def as_pixels(df: DataFrame) -> DataFrame:
    """A row for each sample: what names the image and channel, x, y, v."""
    names = [c for c in df.columns if c not in ("width", "height", "v")]
    return df.select(*names, "width", F.posexplode("v").alias("i", "v")).select(*names, x_of(F.col("i")).alias("x"), y_of(F.col("i")).alias("y"), "v")


def convolve(df: DataFrame, kernel: str) -> DataFrame:
    """Edges are continued; weights are whole, so sums are exact in any order."""
    weights, scale, offset = KERNELS[kernel]
    side = int(len(weights) ** 0.5)
    taps = [(k % side - side // 2, k // side - side // 2, w) for k, w in enumerate(weights) if w]
    return mapped(df, lambda v, i: byte((f32(total(tap(v, i, dx, dy) * w for dx, dy, w in taps)) / f32(scale) + f32(offset)).cast("float")))


def box_blur(df: DataFrame, radius: int) -> DataFrame:
    """Across, then down; whole division after either; edges are continued."""
    n, reach = 2 * radius + 1, range(-radius, radius + 1)
    across = mapped(df, lambda v, i: F.floor(total(tap(v, i, d, 0) for d in reach) / n).cast("int"))
    return mapped(across, lambda v, i: F.floor(total(tap(v, i, 0, d) for d in reach) / n).cast("int"))


def mean_blur(df: DataFrame, radius: int) -> DataFrame:
    """The mean of what of the square lies inside the image."""
    def of(v: Column, i: Column) -> Column:
        some = [(tap(v, i, dx, dy), inside(i, dx, dy)) for dx, dy in square(radius)]
        return F.floor(total(F.when(ok, t).otherwise(0) for t, ok in some) / total(F.when(ok, 1).otherwise(0) for _, ok in some)).cast("int")

    return mapped(df, of)


def neighbours(v: Column, i: Column, radius: int) -> Column:
    return F.array(*[tap(v, i, dx, dy) for dx, dy in square(radius)])


def median(df: DataFrame, radius: int) -> DataFrame:
    return mapped(df, lambda v, i: F.get(F.sort_array(neighbours(v, i, radius)), F.lit((2 * radius + 1) ** 2 // 2)))


def dilate(df: DataFrame, radius: int) -> DataFrame:
    return mapped(df, lambda v, i: F.array_max(neighbours(v, i, radius)))


def erode(df: DataFrame, radius: int) -> DataFrame:
    return mapped(df, lambda v, i: F.array_min(neighbours(v, i, radius)))


def unsharp(df: DataFrame, amount: float, level: int) -> DataFrame:
    """Adds a share of the difference from the blurred image where that is at least `level`."""
    soft = convolve(df.withColumn("old", F.col("v")), "gauss5")
    sharper = lambda a, b: byte((f32(a) + f32(amount) * f32(a - b)).cast("float"))
    return soft.withColumn("v", F.zip_with("old", "v", lambda a, b: F.when(F.abs(a - b) >= level, sharper(a, b)).otherwise(a))).drop("old")


def bilateral(df: DataFrame, radius: int, sigma_space: float, sigma_range: float) -> DataFrame:
    """Weights fall with distance and with difference."""
    def of(v: Column, i: Column) -> Column:
        own = F.get(v, i)
        weighed = []
        for dx, dy in square(radius):
            near, t = exp(-(dx * dx + dy * dy) / (2 * sigma_space**2)), tap(v, i, dx, dy)
            weighed.append((t, F.lit(near) * F.exp(-(t - own) * (t - own) / (2 * sigma_range**2))))
        return F.floor(F.round(total(t * w for t, w in weighed) / total(w for _, w in weighed), 6)).cast("int")

    return mapped(df, of)


def rank_equalize(df: DataFrame, radius: int) -> DataFrame:
    """The share of the neighbourhood (inside the image) that isn't brighter, times 255."""
    def of(v: Column, i: Column) -> Column:
        own = F.get(v, i)
        some = [(tap(v, i, dx, dy), inside(i, dx, dy)) for dx, dy in square(radius)]
        return F.floor(total(F.when(ok & (t <= own), 1).otherwise(0) for t, ok in some) * 255 / total(F.when(ok, 1).otherwise(0) for _, ok in some)).cast("int")

    return mapped(df, of)


#: The eight neighbours clockwise from the upper left.
RING = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))


def binary_pattern(df: DataFrame) -> DataFrame:
    """A bit for each neighbour that is no darker, the upper left first; borders stay as they are."""
    def of(v: Column, i: Column) -> Column:
        own = F.get(v, i)
        border = (x_of(i) == 0) | (x_of(i) == width() - 1) | (y_of(i) == 0) | (y_of(i) == height() - 1)
        return F.when(border, own).otherwise(total(F.when(tap(v, i, dx, dy) >= own, 1 << (7 - k)).otherwise(0) for k, (dx, dy) in enumerate(RING)))

    return mapped(df, of)


def commonest(stack: np.ndarray, radius: int, bins: int) -> np.ndarray:
    """oil_paint of a stack (image, y, x): each bin's samples are counted and added up over all squares at once."""
    def around(v: np.ndarray) -> np.ndarray:
        for axis in (1, 2):
            size, room = v.shape[axis], [(radius, radius) if axis == k else (0, 0) for k in range(3)]
            wide = np.pad(v, room)
            v = sum(wide.take(range(d, d + size), axis) for d in range(2 * radius + 1))
        return v

    most, total = np.zeros_like(stack), np.zeros_like(stack)
    for b in range(bins):
        own = stack * bins // 256 == b
        n = around(own.astype(stack.dtype))
        more = n > most
        most, total = np.where(more, n, most), np.where(more, around(np.where(own, stack, 0)), total)
    return total // most


def oil_paint(df: DataFrame, radius: int, bins: int) -> DataFrame:
    """The whole mean of the commonest intensity bin of the neighbourhood inside the image; the lowest of equals.

    Some images of one size are stacked inside Arrow batches; an image without samples stays as it is.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, h, some in stacks(parts):
            full = some["v"].map(lambda v: v is not None and len(v) > 0)
            if not full.all():
                yield some[~full]
            if full.any():
                some = some[full]
                yield some.assign(v=list(commonest(np.stack(some["v"].to_list()).reshape(len(some), h, w).astype(np.int32), radius, bins).reshape(len(some), -1)))

    return df.mapInPandas(run, df.schema)


def resize(df: DataFrame, new_width: int, new_height: int) -> DataFrame:
    """Bilinear, aligned at the upper left, truncated."""
    wide, high = F.lit(new_width), F.lit(new_height)

    def of(v: Column, i: Column) -> Column:
        px = (f32(x_of(i, wide)) * f32(width() / new_width)).cast("float")
        py = (f32(y_of(i, wide)) * f32(height() / new_height)).cast("float")
        ix, iy = clamp(F.floor(px).cast("int"), width() - 1), clamp(F.floor(py).cast("int"), height() - 1)
        nx, ny = clamp(ix + 1, width() - 1), clamp(iy + 1, height() - 1)
        dx, dy = px - f32(ix), py - f32(iy)
        at = lambda y, x: f32(F.get(v, y * width() + x))
        one = f32(1)
        return byte((one - dx) * (one - dy) * at(iy, ix) + dx * (one - dy) * at(iy, nx) + (one - dx) * dy * at(ny, ix) + dx * dy * at(ny, nx))

    return mapped(df, of, wide, high)


def moved(df: DataFrame, source, w: Column | None = None, h: Column | None = None) -> DataFrame:
    """A result of w x h (None: as the image) whose sample at (x, y) is that at source(x, y) of the image; outside it is 0."""
    wide, high = width() if w is None else w, height() if h is None else h

    def of(v: Column, i: Column) -> Column:
        x, y = source(x_of(i, wide), y_of(i, wide))
        return F.when((x >= 0) & (x < width()) & (y >= 0) & (y < height()), F.get(v, clamp(y, height() - 1) * width() + clamp(x, width() - 1))).otherwise(0)

    return mapped(df, of, wide, high)


def rotate(df: DataFrame, degrees: float) -> DataFrame:
    """Turned about the centre on a canvas that holds it; bilinear where all four samples are inside, else 0."""
    c, s = cos(radians(degrees)), sin(radians(degrees))
    whole = lambda a, b: F.ceil(F.round(F.abs(a) + F.abs(b), 4)).cast("int")
    wide, high = whole(width() * c, height() * s), whole(width() * s, height() * c)

    def of(v: Column, i: Column) -> Column:
        ox, oy = x_of(i, wide) - wide / 2, y_of(i, wide) - high / 2
        sx, sy = F.round(ox * c + oy * s + width() / 2, 6), F.round(-ox * s + oy * c + height() / 2, 6)
        ix, iy = F.floor(sx).cast("int"), F.floor(sy).cast("int")
        tx, ty = sx - ix, sy - iy
        at = lambda y, x: F.get(v, clamp(y, height() - 1) * width() + clamp(x, width() - 1))
        top, low = at(iy, ix) + tx * (at(iy, ix + 1) - at(iy, ix)), at(iy + 1, ix) + tx * (at(iy + 1, ix + 1) - at(iy + 1, ix))
        whole = (ix >= 0) & (ix + 1 < width()) & (iy >= 0) & (iy + 1 < height())
        return F.when(whole, F.floor(F.round(top + ty * (low - top), 6)).cast("int")).otherwise(0)

    return mapped(df, of, wide, high)


def kuwahara(df: DataFrame, radius: int = 1) -> DataFrame:
    """The whole mean of the quarter of the neighbourhood that varies least, the first of equals; edges are continued."""
    def of(v: Column, i: Column) -> Column:
        n, found = (radius + 1) ** 2, []
        for k, (sx, sy) in enumerate(((-1, -1), (1, -1), (-1, 1), (1, 1))):
            taps = [tap(v, i, sx * dx, sy * dy) for dy in range(radius + 1) for dx in range(radius + 1)]
            sums, squares = total(taps), total(t * t for t in taps)
            found.append(F.struct((squares * n - sums * sums).alias("varies"), F.lit(k).alias("k"), F.floor(sums / n).cast("int").alias("mean")))
        return F.array_min(F.array(*found))["mean"]

    return mapped(df, of)


# What follows is the same in SQL: pixels joined with their neighbours.

def _taps(reach: int) -> str:
    r = f"range(-{reach}, {reach + 1})"
    return f"(SELECT dx, dy FROM (SELECT unnest({r}) AS dx), (SELECT unnest({r}) AS dy))"


_EDGE = "s.x = greatest(0, least(7, t.x + dx)) AND s.y = greatest(0, least(7, t.y + dy))"
_WITHIN = "s.x = t.x + dx AND s.y = t.y + dy"


def _near(value: str, reach: int, on: str = _EDGE, taps: str = "") -> str:
    return pick(f"t.image_id, t.x, t.y, {value} AS v", f"gr t, {taps or _taps(reach)} k JOIN gr s ON s.image_id = t.image_id AND {on} GROUP BY t.image_id, t.x, t.y, t.v")


def _convolution(kernel: str) -> str:
    weights, scale, offset = KERNELS[kernel]
    side = int(len(weights) ** 0.5)
    rows = ", ".join(f"({k % side - side // 2}, {k // side - side // 2}, {w})" for k, w in enumerate(weights))
    return _near(sql_byte(f"{f('sum(w * s.v)')} / {f(scale)} + {f(offset)}"), 0, taps=f"(VALUES {rows}) AS k0(dx, dy, w)").replace("AS k0(dx, dy, w) k", "AS k(dx, dy, w)")


_BOX = PX + """, h AS (SELECT t.image_id, t.x, t.y, CAST(sum(s.v) // 3 AS INTEGER) AS v FROM gr t, (SELECT unnest(range(-1, 2)) AS d) JOIN gr s ON s.image_id = t.image_id AND s.y = t.y AND s.x = greatest(0, least(7, t.x + d)) GROUP BY ALL)
SELECT t.image_id, t.x, t.y, CAST(sum(s.v) // 3 AS INTEGER) AS v FROM h t, (SELECT unnest(range(-1, 2)) AS d) JOIN h s ON s.image_id = t.image_id AND s.x = t.x AND s.y = greatest(0, least(7, t.y + d)) GROUP BY t.image_id, t.x, t.y"""
_UNSHARP = PX + f", c AS ({_convolution('gauss5')[len(PX):]}) SELECT gr.image_id, gr.x, gr.y, CASE WHEN abs(gr.v - c.v) >= 4 THEN {sql_byte(f'{f('gr.v')} + {f(0.75)} * {f('(gr.v - c.v)')}')} ELSE gr.v END AS v FROM gr JOIN c USING (image_id, x, y)"
_WEIGHT = "exp(-(dx * dx + dy * dy) / CAST(4.5 AS DOUBLE)) * exp(-CAST((s.v - t.v) * (s.v - t.v) AS DOUBLE) / 1800)"
_PATTERN = pick(
    "t.image_id, t.x, t.y, CASE WHEN t.x IN (0, 7) OR t.y IN (0, 7) THEN t.v ELSE CAST(sum(CASE WHEN s.v >= t.v THEN w ELSE 0 END) AS INTEGER) END AS v",
    "gr t, (VALUES (-1, -1, 128), (0, -1, 64), (1, -1, 32), (1, 0, 16), (1, 1, 8), (0, 1, 4), (-1, 1, 2), (-1, 0, 1)) AS k(dx, dy, w) JOIN gr s ON s.image_id = t.image_id AND " + _EDGE + " GROUP BY t.image_id, t.x, t.y, t.v")
_OIL = PX + f""", b AS (SELECT t.image_id, t.x, t.y, s.v * 8 // 256 AS bin, count(*) AS n, sum(s.v) AS total FROM gr t, {_taps(1)} k JOIN gr s ON s.image_id = t.image_id AND {_WITHIN} GROUP BY ALL)
SELECT image_id, x, y, CAST(total // n AS INTEGER) AS v FROM b QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY n DESC, bin) = 1"""


def _at(width: int, height: int, x: str, y: str) -> str:
    """Samples of the result from (x, y) of the source, in terms of tx and ty; 0 outside."""
    return (f"{PX}, t AS (SELECT CAST(i % {width} AS INTEGER) AS tx, CAST(i // {width} AS INTEGER) AS ty FROM (SELECT unnest(range({width * height})) AS i)), im AS (SELECT DISTINCT image_id FROM gr) "
            f"SELECT im.image_id, tx AS x, ty AS y, coalesce(gr.v, 0) AS v FROM im CROSS JOIN t LEFT JOIN gr ON gr.image_id = im.image_id AND gr.x = {x} AND gr.y = {y}")


_RESIZE = PX + f""", q AS (SELECT image_id, v, CAST(i % 12 AS INTEGER) AS x, CAST(i // 12 AS INTEGER) AS y FROM (SELECT image_id, v, unnest(range(60)) AS i FROM e)),
p AS (SELECT *, {f('x')} * {f(8 / 12)} AS px, {f('y')} * {f(8 / 5)} AS py FROM q),
o AS (SELECT *, CAST(floor(px) AS INTEGER) AS ix, CAST(floor(py) AS INTEGER) AS iy FROM p),
z AS (SELECT *, least(ix + 1, 7) AS nx, least(iy + 1, 7) AS ny, px - {f('ix')} AS dx, py - {f('iy')} AS dy FROM o)
SELECT image_id, x, y, {sql_byte(f"({f(1)} - dx) * ({f(1)} - dy) * {f('v[iy * 8 + ix + 1]')} + dx * ({f(1)} - dy) * {f('v[iy * 8 + nx + 1]')} + ({f(1)} - dx) * dy * {f('v[ny * 8 + ix + 1]')} + dx * dy * {f('v[ny * 8 + nx + 1]')}")} AS v FROM z"""
_C, _S = (f"CAST({v!r} AS DOUBLE)" for v in (cos(radians(30)), sin(radians(30))))
_ROTATE = PX + f""", q AS (SELECT image_id, v, CAST(i % 11 AS INTEGER) AS x, CAST(i // 11 AS INTEGER) AS y FROM (SELECT image_id, v, unnest(range(121)) AS i FROM e)),
p AS (SELECT *, round((x - 5.5) * {_C} + (y - 5.5) * {_S} + 4, 6) AS sx, round(-(x - 5.5) * {_S} + (y - 5.5) * {_C} + 4, 6) AS sy FROM q),
o AS (SELECT *, CAST(floor(sx) AS INTEGER) AS ix, CAST(floor(sy) AS INTEGER) AS iy FROM p),
z AS (SELECT *, ix >= 0 AND ix < 7 AND iy >= 0 AND iy < 7 AS ok, sx - ix AS tx, sy - iy AS ty FROM o),
w AS (SELECT *, v[iy * 8 + ix + 1] AS a, v[iy * 8 + ix + 2] AS b, v[iy * 8 + ix + 9] AS c, v[iy * 8 + ix + 10] AS d FROM z)
SELECT image_id, x, y, CASE WHEN ok THEN CAST(floor(round((a + tx * (b - a)) + ty * ((c + tx * (d - c)) - (a + tx * (b - a))), 6)) AS INTEGER) ELSE 0 END AS v FROM w"""


_MOVES = {
    "flip_horizontal": (lambda x, y: (width() - 1 - x, y), ("7 - tx", "ty")),
    "flip_vertical": (lambda x, y: (x, height() - 1 - y), ("tx", "7 - ty")),
    "rotate_180": (lambda x, y: (width() - 1 - x, height() - 1 - y), ("7 - tx", "7 - ty")),
    "translate": (lambda x, y: (x - 2, y + 1), ("tx - 2", "ty + 1")),
}
#: Quarter turns change width for height.
_TURNS = {
    "rotate_90": (lambda x, y: (y, height() - 1 - x), ("ty", "7 - tx")),
    "rotate_270": (lambda x, y: (width() - 1 - y, x), ("7 - ty", "tx")),
}

# Colour images that aren't square: every channel by itself.

_LINKED = "s.image_id = t.image_id AND s.channel = t.channel"


def _colour(value: str, reach: int, on: str, taps: str = "") -> str:
    return (f"{QUILTS} SELECT t.image_id, t.channel, t.x, t.y, {value} AS v FROM gr t, {taps or _taps(reach)} k "
            f"JOIN gr s ON {_LINKED} AND {on} GROUP BY t.image_id, t.channel, t.x, t.y, t.v")


_EDGE_32 = "s.x = greatest(0, least(31, t.x + dx)) AND s.y = greatest(0, least(23, t.y + dy))"
_GAUSS = _colour(sql_byte(f"{f('sum(w * s.v)')} / {f(159)}"), 0, _EDGE_32, "(VALUES " + ", ".join(f"({k % 5 - 2}, {k // 5 - 2}, {w})" for k, w in enumerate(KERNELS["gauss5"][0])) + ") AS k0(dx, dy, w)").replace("AS k0(dx, dy, w) k", "AS k(dx, dy, w)")
_KUWAHARA = (f"{QUILTS}, qu(k, dx, dy) AS (VALUES " + ", ".join(f"({k}, {sx * dx}, {sy * dy})" for k, (sx, sy) in enumerate(((-1, -1), (1, -1), (-1, 1), (1, 1))) for dy in (0, 1) for dx in (0, 1)) + "), "
             f"qs AS (SELECT t.image_id, t.channel, t.x, t.y, k, sum(s.v) AS a, sum(s.v * s.v) AS b FROM gr t, qu JOIN gr s ON {_LINKED} AND {_EDGE_32} GROUP BY ALL) "
             "SELECT image_id, channel, x, y, CAST(a // 4 AS INTEGER) AS v FROM qs QUALIFY row_number() OVER (PARTITION BY image_id, channel, x, y ORDER BY b * 4 - a * a, k) = 1")
_TURNED_32 = f"{QUILTS} SELECT image_id, channel, 23 - y AS x, x AS y, v FROM gr"

OPS = {
    **{f"convolve_{k}": (lambda s, d, k=k: as_pixels(convolve(images(s, d), k)), _convolution(k)) for k in KERNELS},
    "box_blur": (lambda s, d: as_pixels(box_blur(images(s, d), 1)), _BOX),
    "mean_blur": (lambda s, d: as_pixels(mean_blur(images(s, d), 2)), _near("CAST(sum(s.v) // count(*) AS INTEGER)", 2, _WITHIN)),
    "median_filter": (lambda s, d: as_pixels(median(images(s, d), 1)), _near("list_sort(list(s.v))[5]", 1)),
    "dilate": (lambda s, d: as_pixels(dilate(images(s, d), 1)), _near("max(s.v)", 1)),
    "erode": (lambda s, d: as_pixels(erode(images(s, d), 1)), _near("min(s.v)", 1)),
    "unsharp_mask": (lambda s, d: as_pixels(unsharp(images(s, d), 0.75, 4)), _UNSHARP),
    "bilateral_filter": (
        lambda s, d: as_pixels(bilateral(images(s, d), 2, 1.5, 30.0)),
        _near(f"CAST(floor(round(sum(s.v * {_WEIGHT}) / sum({_WEIGHT}), 6)) AS INTEGER)", 2)),
    "rank_equalize": (
        lambda s, d: as_pixels(rank_equalize(images(s, d), 2)),
        _near("CAST(count(*) FILTER (s.v <= t.v) * 255 // count(*) AS INTEGER)", 2, _WITHIN)),
    "local_binary_pattern": (lambda s, d: as_pixels(binary_pattern(images(s, d))), _PATTERN),
    "oil_paint": (lambda s, d: as_pixels(oil_paint(images(s, d), 1, 8)), _OIL),
    "resize": (lambda s, d: as_pixels(resize(images(s, d), 12, 5)), _RESIZE),
    "rotate": (lambda s, d: as_pixels(rotate(images(s, d), 30)), _ROTATE),
    "crop": (lambda s, d: as_pixels(moved(images(s, d), lambda x, y: (x + 2, y + 3), F.lit(4), F.lit(7))), _at(4, 7, "tx + 2", "ty + 3")),
    **{k: (lambda s, d, to=to: as_pixels(moved(images(s, d), to)), _at(8, 8, *sql)) for k, (to, sql) in _MOVES.items()},
    **{k: (lambda s, d, to=to: as_pixels(moved(images(s, d), to, height(), width())), _at(8, 8, *sql)) for k, (to, sql) in _TURNS.items()},
    "gradients": (lambda s, d: as_pixels(quilts(s, d)), QUILTS + " SELECT * FROM gr"),
    "colour_gauss5": (lambda s, d: as_pixels(convolve(quilts(s, d), "gauss5")), _GAUSS),
    "colour_median": (lambda s, d: as_pixels(median(quilts(s, d), 1)), _colour("list_sort(list(s.v))[5]", 1, _EDGE_32)),
    "colour_dilate": (lambda s, d: as_pixels(dilate(quilts(s, d), 2)), _colour("max(s.v)", 2, _EDGE_32)),
    "colour_erode": (lambda s, d: as_pixels(erode(quilts(s, d), 1)), _colour("min(s.v)", 1, _EDGE_32)),
    "colour_mean_blur": (lambda s, d: as_pixels(mean_blur(quilts(s, d), 1)), _colour("CAST(sum(s.v) // count(*) AS INTEGER)", 1, _WITHIN)),
    "colour_kuwahara": (lambda s, d: as_pixels(kuwahara(quilts(s, d))), _KUWAHARA),
    "colour_rotate_90": (lambda s, d: as_pixels(moved(quilts(s, d), _TURNS["rotate_90"][0], height(), width())), _TURNED_32),
    "colour_flip": (lambda s, d: as_pixels(moved(quilts(s, d), _MOVES["flip_horizontal"][0])), f"{QUILTS} SELECT image_id, channel, 31 - x AS x, y, v FROM gr"),
    "colour_crop": (lambda s, d: as_pixels(moved(quilts(s, d), lambda x, y: (x + 5, y + 9), F.lit(20), F.lit(11))), f"{QUILTS} SELECT image_id, channel, x - 5 AS x, y - 9 AS y, v FROM gr WHERE x BETWEEN 5 AND 24 AND y BETWEEN 9 AND 19"),
}
