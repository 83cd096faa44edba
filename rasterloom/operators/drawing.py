"""Shapes as arrays of points, made by expressions from their parameters, and mixed into images.

A shape's points are an array of (x, y) in the order in which they are set; a point that is set twice is mixed in
twice.  Parameters are Columns, so a table of shapes is drawn as one projection; the points then meet the pixels of
their image in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..oracle import PX
from ..sources.tables import KEY, pixels


def whole(value) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def count_up(last: Column) -> Column:
    """0 to last; nothing if last is below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def line(x0, y0, x1, y1) -> Column:
    """A line with both ends: a step along the longer way for each point, the shorter way rounded, halves down."""
    x0, y0, x1, y1 = map(whole, (x0, y0, x1, y1))
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    n = F.greatest(dx, dy)
    across = lambda k, own: F.when(own == n, k).otherwise(F.floor((k * own * 2 + n - 1) / (n * 2)).cast("int"))
    sign = lambda a, b: F.when(a < b, 1).otherwise(-1)
    return F.transform(count_up(n), lambda k: point(x0 + sign(x0, x1) * across(k, dx), y0 + sign(y0, y1) * across(k, dy)))


def rectangle(x, y, width, height, filled: bool = False) -> Column:
    """Filled row by row; or the outline as four lines, whose corners are set twice."""
    x, y, width, height = map(whole, (x, y, width, height))
    right, low = x + width - 1, y + height - 1
    if filled:
        return F.flatten(F.transform(count_up(height - 1), lambda k: line(x, y + k, right, y + k)))
    return F.concat(line(x, y, right, y), line(x, low, right, low), line(x, y, x, low), line(right, y, right, low))


def circle(cx, cy, radius, filled: bool = False) -> Column:
    """By the midpoint rule, eight points for each step; or the spans between them."""
    cx, cy, radius = map(whole, (cx, cy, radius))
    begin = F.struct(F.array(point(F.lit(0), radius)).alias("at"), F.lit(0).alias("x"), radius.alias("y"), (F.lit(3) - radius * 2).alias("d"))

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"] + 1, F.when(s["d"] > 0, s["y"] - 1).otherwise(s["y"])
        d = F.when(s["d"] > 0, s["d"] + (x - y) * 4 + 10).otherwise(s["d"] + x * 4 + 6)
        return F.when(s["y"] < s["x"], s).otherwise(F.struct(F.concat(s["at"], F.array(point(x, y))).alias("at"), x.alias("x"), y.alias("y"), d.alias("d")))

    arc = F.aggregate(count_up(radius + 1), begin, step)["at"]
    if filled:
        spans = lambda p: F.concat(
            line(cx - p["x"], cy + p["y"], cx + p["x"], cy + p["y"]), line(cx - p["x"], cy - p["y"], cx + p["x"], cy - p["y"]),
            line(cx - p["y"], cy + p["x"], cx + p["y"], cy + p["x"]), line(cx - p["y"], cy - p["x"], cx + p["y"], cy - p["x"]))
        return F.flatten(F.transform(arc, spans))
    eight = lambda p: F.array(*[point(cx + a, cy + b) for u, v in ((p["x"], p["y"]), (p["y"], p["x"])) for a, b in ((u, v), (-u, v), (u, -v), (-u, -v))])
    return F.flatten(F.transform(arc, eight))


def ellipse_filled(cx, cy, rx, ry) -> Column:
    """Spans row by row; of height 0, one span."""
    cx, cy, rx, ry = map(whole, (cx, cy, rx, ry))
    reach = lambda y: F.when(ry == 0, rx).otherwise(F.round(rx * F.sqrt(F.lit(1.0) - (y * y) / (ry * ry))).cast("int"))
    return F.flatten(F.transform(F.sequence(-ry, ry), lambda y: line(cx - reach(y), cy + y, cx + reach(y), cy + y)))


def ellipse(cx, cy, rx, ry) -> Column:
    """The outline by the midpoint rule, four points for each step: steps across, then steps down."""
    cx, cy, rx, ry = map(whole, (cx, cy, rx, ry))
    a, b = (rx * rx).cast("double"), (ry * ry).cast("double")
    four = lambda x, y: F.array(*[point(cx + u, cy + v) for u, v in ((x, y), (-x, y), (x, -y), (-x, -y))])
    begin = F.struct(
        F.array().cast("array<struct<x:int,y:int>>").alias("at"), F.lit(0).alias("x"), ry.alias("y"), (b - a * ry + a / 4).alias("d"),
        F.lit(0.0).alias("dx"), (a * 2 * ry).alias("dy"), F.lit(False).alias("down"),
    )

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        down = s["down"] | (s["dx"] >= s["dy"])
        d = F.when(down & ~s["down"], b * (x + 0.5) * (x + 0.5) + a * (y - 1) * (y - 1) - a * b).otherwise(s["d"])
        right, low = F.when(down, d <= 0).otherwise(F.lit(True)), F.when(down, F.lit(True)).otherwise(d >= 0)
        dx, dy = F.when(right, s["dx"] + b * 2).otherwise(s["dx"]), F.when(low, s["dy"] - a * 2).otherwise(s["dy"])
        after = F.when(down, d + a - dy + F.when(right, dx).otherwise(0.0)).otherwise(d + dx + b - F.when(low, dy).otherwise(0.0))
        return F.when(y < 0, s).otherwise(F.struct(
            F.concat(s["at"], four(x, y)).alias("at"), F.when(right, x + 1).otherwise(x).alias("x"), F.when(low, y - 1).otherwise(y).alias("y"),
            after.alias("d"), dx.alias("dx"), dy.alias("dy"), down.alias("down")))

    return F.aggregate(count_up(rx + ry + 2), begin, step)["at"]


def corners(points: Column, of) -> Column:
    """of(corner, next corner) for every side of a closed polygon."""
    n = F.size(points)
    return F.transform(points, lambda p, i: of(p, F.get(points, (i + 1) % n)))


def polygon(points: Column, filled: bool = False) -> Column:
    """points: array of (x, y), three or more.  Filled row by row between pairs of crossings (even-odd)."""
    if not filled:
        return F.flatten(corners(points, lambda p, q: line(p["x"], p["y"], q["x"], q["y"])))
    ys = F.transform(points, lambda p: p["y"])

    def row(y: Column) -> Column:
        crossing = lambda p, q: F.when(
            ((p["y"] < y) & (q["y"] >= y)) | ((q["y"] < y) & (p["y"] >= y)),
            (p["x"] + (y - p["y"]) * (q["x"] - p["x"]).cast("double") / F.nullif(q["y"] - p["y"], F.lit(0))).cast("int"))
        found = F.sort_array(F.array_compact(corners(points, crossing)))
        pairs = F.filter(found, lambda x, i: (i % 2 == 0) & (i + 1 < F.size(found)))
        return F.flatten(F.transform(pairs, lambda x, i: line(x, y, F.get(found, i * 2 + 1), y)))

    return F.flatten(F.transform(F.sequence(F.array_min(ys), F.array_max(ys)), row))


def bezier(points: list[tuple[int, int]]) -> Column:
    """A curve with one control point or two, as lines between 10 to 100 (150 with two) evenly spaced places."""
    n = len(points) - 1
    way = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(points, points[1:])) / n
    steps = int(min(max(way, 10.0), {2: 100.0, 3: 150.0}[n]))
    weights = {2: (1, 2, 1), 3: (1, 3, 3, 1)}[n]
    at = lambda i, c: F.round(sum((F.pow(1 - i / steps, F.lit(n - k)) * F.pow(i / steps, F.lit(k)) * (w * points[k][c]) for k, w in enumerate(weights)), F.lit(0.0))).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(at(i, 0), at(i, 1)))
    sides = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(F.get(places, i).alias("p"), F.get(places, i + 1).alias("q")))
    return F.flatten(F.transform(sides, lambda s: line(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])))


def drawn(df: DataFrame, shapes: DataFrame, color: tuple[int, int, int], alpha: int = 255) -> DataFrame:
    """Pixels with the points of shapes (image_id, points) mixed in by alpha, truncated, as often as they are set.

    Points outside of an image are left out; alpha becomes the greater of the two.
    """
    times = shapes.select("image_id", F.explode("points").alias("p")).groupBy("image_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count("*").cast("int").alias("times"))
    mixed = lambda c, v: F.aggregate(F.sequence(F.lit(1), F.col("times")), F.col(c).cast("int"), lambda a, _: F.floor((a * (255 - alpha) + v * alpha) / 255).cast("int"))
    there = F.col("times").isNotNull()
    return df.join(times, KEY, "left").select(
        *KEY, *[F.when(there, mixed(c, v)).otherwise(F.col(c)).alias(c) for c, v in zip("rgb", color)],
        F.when(there, F.greatest("a", F.lit(alpha))).otherwise(F.col("a")).alias("a"))


def on_images(s, d, points: Column) -> DataFrame:
    px = pixels(s, d)
    return drawn(px, px.filter("x = 0 AND y = 0").select("image_id", points.alias("points")), (250, 20, 90), 100)


def _drawn_sql(points: str) -> str:
    """points: a query for x and y, a row for each time that a point is set."""
    once = lambda c, v: f"({c} * 155 + {v} * 100) // 255"
    many = lambda c, v: f"CAST(CASE coalesce(n, 0) WHEN 0 THEN {c} WHEN 1 THEN {once(c, v)} WHEN 2 THEN {once(once(c, v), v)} WHEN 3 THEN {once(once(once(c, v), v), v)} ELSE {once(once(once(once(c, v), v), v), v)} END AS INTEGER)"
    return (PX.replace("WITH e", "WITH RECURSIVE e") + f", {points}, ti AS (SELECT x, y, count(*) AS n FROM pt GROUP BY ALL) SELECT image_id, px.x, px.y, {', '.join(f'{many(c, v)} AS {c}' for c, v in zip('rgb', (250, 20, 90)))}, "
            "CASE WHEN n IS NULL THEN a ELSE greatest(a, 100) END AS a FROM px LEFT JOIN ti ON ti.x = px.x AND ti.y = px.y")


def _line_sql(x0: int, y0: int, x1: int, y1: int) -> str:
    """The stepping form: an error term that decides in which directions the next step goes."""
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1
    return (f"pt AS (SELECT {x0} AS x, {y0} AS y, {dx - dy} AS e UNION ALL SELECT CASE WHEN 2 * e > {-dy} THEN x + ({sx}) ELSE x END, CASE WHEN 2 * e < {dx} THEN y + ({sy}) ELSE y END, "
            f"e - CASE WHEN 2 * e > {-dy} THEN {dy} ELSE 0 END + CASE WHEN 2 * e < {dx} THEN {dx} ELSE 0 END FROM pt WHERE NOT (x = {x1} AND y = {y1}))")


_ARC = "ar AS (SELECT 0 AS x, 3 AS y, -3 AS d UNION ALL SELECT x + 1, CASE WHEN d > 0 THEN y - 1 ELSE y END, CASE WHEN d > 0 THEN d + 4 * (x + 1 - (y - 1)) + 10 ELSE d + 4 * (x + 1) + 6 END FROM ar WHERE y >= x)"
_CIRCLE = _ARC + ", pt AS (SELECT unnest([4 + x, 4 - x, 4 + x, 4 - x, 4 + y, 4 - y, 4 + y, 4 - y]) AS x, unnest([4 + y, 4 + y, 4 - y, 4 - y, 4 + x, 4 + x, 4 - x, 4 - x]) AS y FROM ar)"
_ELLIPSE = "ro AS (SELECT unnest(range(-2, 3)) AS v), sp AS (SELECT v, CAST(round(3 * sqrt(1 - v * v / CAST(4 AS DOUBLE))) AS INTEGER) AS w FROM ro), pt AS (SELECT unnest(range(4 - w, 5 + w)) AS x, 3 + v AS y FROM sp)"
#: The corners of the polygon that the query draws.
CORNERS = ((1, 0), (6, 2), (5, 7), (2, 4), (0, 6))
_SIDES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1]))
_POLYGON = (f"si(ax, ay, zx, zy) AS (VALUES {_SIDES}), ro AS (SELECT unnest(range(0, 8)) AS y), cr AS (SELECT y, CAST(trunc(ax + (y - ay) * CAST(zx - ax AS DOUBLE) / (zy - ay)) AS INTEGER) AS x FROM si, ro WHERE (ay < y AND zy >= y) OR (zy < y AND ay >= y)), "
            "nu AS (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY x) AS k FROM cr), pt AS (SELECT unnest(range(p.x, q.x + 1)) AS x, p.y AS y FROM nu p JOIN nu q ON q.y = p.y AND q.k = p.k + 1 WHERE p.k % 2 = 1)")


def polygon_of(corners_: tuple) -> Column:
    return F.array(*[point(F.lit(x), F.lit(y)) for x, y in corners_])


OPS = {
    "draw_line_flat": (lambda s, d: on_images(s, d, line(7, 1, 0, 4)), _drawn_sql(_line_sql(7, 1, 0, 4))),
    "draw_line_steep": (lambda s, d: on_images(s, d, line(2, 6, 5, 0)), _drawn_sql(_line_sql(2, 6, 5, 0))),
    "draw_outline": (lambda s, d: on_images(s, d, rectangle(1, 1, 5, 4)), _drawn_sql("pt AS (SELECT unnest(range(1, 6)) AS x, unnest([1, 1, 1, 1, 1]) AS y UNION ALL SELECT unnest(range(1, 6)), unnest([4, 4, 4, 4, 4]) UNION ALL SELECT unnest([1, 1, 1, 1]), unnest(range(1, 5)) UNION ALL SELECT unnest([5, 5, 5, 5]), unnest(range(1, 5)))")),
    "draw_circle": (lambda s, d: on_images(s, d, circle(4, 4, 3)), _drawn_sql(_CIRCLE)),
    "draw_ellipse_filled": (lambda s, d: on_images(s, d, ellipse_filled(4, 3, 3, 2)), _drawn_sql(_ELLIPSE)),
    "draw_polygon_filled": (lambda s, d: on_images(s, d, polygon(polygon_of(CORNERS), True)), _drawn_sql(_POLYGON)),
    "draw_curve": (lambda s, d: on_images(s, d, bezier([(0, 7), (3, -4), (7, 6)])), None),
}
