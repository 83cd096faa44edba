"""Anti-aliased shapes, and images cut into shifted strips by a generator.

A shape is an array of points with the share of a sample that it covers, in the order in which they are set, made by
expressions from its parameters.  Points of one place meet in one short array and are mixed in one after the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chance import rand
from ..oracle import PX
from ..sources.tables import KEY, pixels, table
from .drawing import count_up
from .effects import over_stacks, spread, whole_images

Place = tuple[Column, Column]


def dot(x: Column, y: Column, share: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), share.cast("double").alias("c"))


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(v: Column) -> Column:
    """Cut towards 0."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")


def smooth_line(x0, y0, x1, y1) -> Column:
    """Two points for each step along the longer way, whose shares are 1 together; ends count by how far they reach into their sample."""
    x0, y0, x1, y1 = ((F.lit(float(v)) if isinstance(v, (int, float)) else v) for v in (x0, y0, x1, y1))
    steep = F.abs(y1 - y0) > F.abs(x1 - x0)
    turned = F.struct(*[F.when(steep, b).otherwise(a).alias(n) for n, a, b in (("ax", x0, y0), ("ay", y0, x0), ("bx", x1, y1), ("by", y1, x1))], steep.alias("steep"))

    def forward(t: Column) -> Column:
        back = t["ax"] > t["bx"]
        pick = lambda a, b: F.when(back, t[b]).otherwise(t[a])
        dx, dy = pick("bx", "ax") - pick("ax", "bx"), pick("by", "ay") - pick("ay", "by")
        slope = F.when(dx == 0, 1.0).otherwise(dy / F.when(dx != 0, dx))
        return F.struct(pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"), slope.alias("g"), t["steep"].alias("steep"))

    def points(t: Column) -> Column:
        fraction = lambda v: v - F.floor(v)
        pair = lambda at, v, gap: F.array(*[
            dot(F.when(t["steep"], whole(v) + k).otherwise(at), F.when(t["steep"], at).otherwise(whole(v) + k), (fraction(v) if k else 1.0 - fraction(v)) * gap) for k in (0, 1)])
        first, last = whole(t["ax"]), whole(t["bx"])
        start = t["ay"] + t["g"] * (first - t["ax"])
        end = t["by"] + t["g"] * (last - t["bx"])
        half = lambda v: v + 0.5 - whole(v + 0.5)
        inner = F.flatten(F.transform(count_up(last - first - 2), lambda k: pair(first + 1 + k, start + t["g"] * (k + 1), F.lit(1.0))))
        return F.concat(pair(first, start, 1.0 - half(t["ax"])), pair(last, end, half(t["bx"])), inner)

    return let(let(turned, forward), points)


def smooth_circle(cx: float, cy: float, radius: float) -> Column:
    """Samples nearer than 1 to the circle, by how near they are."""
    low, high = int(max(cy - radius - 2, 0)), int(cy + radius + 2)
    left, right = int(max(cx - radius - 2, 0)), int(cx + radius + 2)
    share = lambda x, y: 1.0 - F.abs(F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - radius)
    rows = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda y: F.transform(F.sequence(F.lit(left), F.lit(right)), lambda x: dot(x, y, share(x, y))))
    return F.filter(F.flatten(rows), lambda p: p["c"] > 0)


def smooth_curve(points: list[tuple[float, float]]) -> Column:
    """A curve with one control point (100 lines) or two (150 lines)."""
    n = len(points) - 1
    steps, weights = {2: (100, (1, 2, 1)), 3: (150, (1, 3, 3, 1))}[n]

    def at(i: Column, c: int) -> Column:
        t = i / float(steps)
        power = lambda v, k: F.pow(v, F.lit(k))
        parts = [power(1.0 - t, n - k) * power(t, k) * float(w * points[k][c]) for k, w in enumerate(weights)]
        return sum(parts[1:], parts[0])

    places = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y")))
    sides = lambda v: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(F.get(v, i).alias("p"), F.get(v, i + 1).alias("q")))
    lines = lambda v: F.flatten(F.transform(sides(v), lambda s: smooth_line(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])))
    return let(places, lines)


def mixed_in(df: DataFrame, shapes: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    """Pixels with the points of shapes (image_id, points) mixed in by their shares, in their order, truncated each time; alpha becomes 255."""
    dots = shapes.select("image_id", F.posexplode("points").alias("n", "p")).filter("p.c > 0")
    shares = dots.groupBy("image_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.sort_array(F.collect_list(F.struct("n", F.col("p.c").alias("c")))).alias("l"))
    mix = lambda c, v: F.aggregate("l", F.col(c).cast("int"), lambda a, p: F.floor(F.round(a * (1.0 - p["c"]) + p["c"] * v, 6)).cast("int"))
    there = F.col("l").isNotNull()
    return df.join(shares, KEY, "left").select(*KEY, *[F.when(there, mix(c, v)).otherwise(F.col(c)).alias(c) for c, v in zip("rgb", color)], F.when(there, 255).otherwise(F.col("a")).alias("a"))


COLOUR = (250, 20, 90)


def on_images(s, d, points: Column) -> DataFrame:
    px = pixels(s, d)
    return mixed_in(px, px.filter("x = 0 AND y = 0").select("image_id", points.alias("points")), COLOUR)


def random_strip_sources(width: int, height: int, strip: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the columns from which red and blue, and all other channels, come: arrays (3, height, width).

    A 32-bit generator decides for each strip of rows its height, shift and whether red and blue go ways of their own; strips
    begin every `strip` rows, and later ones cover what earlier ones have set.
    """
    state = seed & 0xFFFFFFFF
    out = np.tile(np.arange(width), (3, height, 1))

    def draw() -> int:
        nonlocal state
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        return state

    for y in range(0, height, strip):
        rows = min(strip + draw() % 5, height - y)
        shift = 0
        if draw() % 10 < 7:
            signed = draw()
            signed -= (signed >> 31) << 32
            shift = (abs(signed) % max(most * 2, 1)) * (1 if signed >= 0 else -1) - most
        apart = draw() % 10 < 3
        at = (np.arange(width) + shift) % width
        out[:, y : y + rows] = at
        if apart:
            for row in range(y, y + rows):
                for x in range(width):
                    for channel in (0, 2):
                        out[channel, row, x] = min(max(at[x] + draw() % 5 - 2, 0), width - 1)
    return out


def torn(strip: int, most: int, seed: int):
    """Images cut into strips of rows that are shifted around, some with red and blue apart; alike for all images of a size."""

    def of(stack: np.ndarray) -> np.ndarray:
        _, h, w, _ = stack.shape
        red, own, blue = random_strip_sources(w, h, strip, most, seed)
        rows = np.arange(h)[:, None]
        return np.stack([stack[:, rows, at, k] for k, at in enumerate((red, own, blue, own))], -1)

    return of


def _segments_sql(segments: str) -> str:
    """segments: a query sg of seq, x0, y0, x1, y1."""
    fold = lambda c, v: f"CAST(list_reduce(list_prepend(CAST(px.{c} AS DOUBLE), l), lambda a, k: floor(round(a * (1 - k) + k * {v}, 6))) AS INTEGER)"
    end = lambda p, gap, k: f"SELECT seq, {k} AS n, trunc({p}x) AS u, {p}y + g * (trunc({p}x) - {p}x) AS v, {gap} AS gap, steep FROM fo"
    half = lambda v: f"({v} + 0.5 - trunc({v} + 0.5))"
    return f"""{PX}, {segments},
tu AS (SELECT seq, abs(y1 - y0) > abs(x1 - x0) AS steep, CASE WHEN abs(y1 - y0) > abs(x1 - x0) THEN [y0, x0, y1, x1] ELSE [x0, y0, x1, y1] END AS t FROM sg),
di AS (SELECT seq, steep, CASE WHEN t[1] > t[3] THEN [t[3], t[4], t[1], t[2]] ELSE t END AS t FROM tu),
fo AS (SELECT seq, steep, t[1] AS ax, t[2] AS ay, t[3] AS bx, t[4] AS by_, CASE WHEN t[3] = t[1] THEN 1.0 ELSE (t[4] - t[2]) / (t[3] - t[1]) END AS g FROM di),
st AS ({end('a', f"1 - {half('ax')}", 0)} UNION ALL {end('b', half('bx'), 1).replace('by ', 'by_ ')}
 UNION ALL SELECT seq, k + 2, trunc(ax) + 1 + k, ay + g * (trunc(ax) - ax) + g * (k + 1), 1.0, steep FROM (SELECT *, unnest(range(CAST(greatest(0, trunc(bx) - trunc(ax) - 1) AS INTEGER))) AS k FROM fo)),
ps AS (SELECT seq, n, j, CASE WHEN steep THEN trunc(v) + j ELSE u END AS x, CASE WHEN steep THEN u ELSE trunc(v) + j END AS y, CASE WHEN j = 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END * gap AS c FROM st, unnest([0, 1]) AS q(j)),
gr2 AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, list(c ORDER BY seq, n, j) AS l FROM ps WHERE c > 0 GROUP BY ALL)
SELECT image_id, px.x, px.y, {', '.join(f'CASE WHEN l IS NULL THEN px.{c} ELSE {fold(c, v)} END AS {c}' for c, v in zip('rgb', COLOUR))}, CASE WHEN l IS NULL THEN a ELSE 255 END AS a FROM px LEFT JOIN gr2 ON gr2.x = px.x AND gr2.y = px.y"""


def _line_sql(*p: float) -> str:
    return _segments_sql("sg AS (SELECT 0 AS seq, " + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for v, n in zip(p, ("x0", "y0", "x1", "y1"))) + ")")


def _curve_sql(points: list[tuple[float, float]]) -> str:
    n = len(points) - 1
    steps, weights = {2: (100, (1, 2, 1)), 3: (150, (1, 3, 3, 1))}[n]
    at = lambda c: " + ".join(f"pow(1 - t, {n - k}) * pow(t, {k}) * {float(w * points[k][c])}" for k, w in enumerate(weights))
    return _segments_sql(f"""ts AS (SELECT i, i / CAST({steps} AS DOUBLE) AS t FROM unnest(range({steps + 1})) AS u(i)), pl AS (SELECT i, {at(0)} AS x, {at(1)} AS y FROM ts),
sg AS (SELECT p.i AS seq, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM pl p JOIN pl q ON q.i = p.i + 1)""")


def _circle_sql(cx: float, cy: float, radius: float) -> str:
    c = f"(1 - abs(sqrt((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy})) - {radius}))"
    out = ", ".join(f"CASE WHEN k > 0 THEN CAST(floor(round({n} * (1 - k) + k * {v}, 6)) AS INTEGER) ELSE {n} END AS {n}" for n, v in zip("rgb", COLOUR))
    return f"{PX}, sh AS (SELECT *, {c} AS k FROM px) SELECT image_id, x, y, {out}, CASE WHEN k > 0 THEN 255 ELSE a END AS a FROM sh"


_RAND = """WITH RECURSIVE st AS (SELECT 0 AS k, CAST(12345678901234 AS UHUGEINT) AS s UNION ALL SELECT k + 1, (s * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT FROM st WHERE k <= (SELECT max(o_orderkey) FROM orders))
SELECT o_orderkey, CAST(s // 2048 AS DOUBLE) / 9007199254740992 AS value FROM orders JOIN st ON k = o_orderkey + 1"""
LINE, STEEP, CURVE, CUBIC = (0.3, 1.2, 6.7, 4.9), (5.5, 7.0, 2.25, 0.5), [(0.0, 7.0), (3.5, -4.0), (7.0, 6.0)], [(0.5, 0.5), (8.0, 1.0), (-2.0, 6.0), (7.0, 7.0)]

OPS = {
    "smooth_line": (lambda s, d: on_images(s, d, smooth_line(*LINE)), _line_sql(*LINE)),
    "smooth_line_steep": (lambda s, d: on_images(s, d, smooth_line(*STEEP)), _line_sql(*STEEP)),
    "smooth_circle": (lambda s, d: on_images(s, d, smooth_circle(3.6, 4.1, 2.7)), _circle_sql(3.6, 4.1, 2.7)),
    "smooth_curve": (lambda s, d: on_images(s, d, smooth_curve(CURVE)), _curve_sql(CURVE)),
    "smooth_curve_cubic": (lambda s, d: on_images(s, d, smooth_curve(CUBIC)), _curve_sql(CUBIC)),
    "random_values": (lambda s, d: table(s, d, "orders").select("o_orderkey", rand(F.col("o_orderkey") + 1).alias("value")), _RAND),
    "glitch": (lambda s, d: spread(over_stacks(whole_images(s, d), torn(2, 3, 20))), None),
}
