"""Rectangles as structs of Columns, single pixels, blank images, alpha by masks and numbers, children put in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blend
from ..oracle import PX, pick
from ..sources.tables import KEY, pixels, table
from .compositing import pairs
from .layers import _LAYERS, _Z, in_place, layers

SIDES = ("x", "y", "w", "h")


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("long").alias(k) for k, v in zip(SIDES, (x, y, w, h))])


def is_empty(r: Column) -> Column:
    return (r["w"] <= 0) | (r["h"] <= 0)


def area(r: Column) -> Column:
    """0 for empty rectangles."""
    return F.when(is_empty(r), 0).otherwise(r["w"] * r["h"])


def contains(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (y >= r["y"]) & (x < r["x"] + r["w"]) & (y < r["y"] + r["h"])


def between(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return rect(x0, y0, F.greatest(x1 - x0, F.lit(0)), F.greatest(y1 - y0, F.lit(0)))


def intersected(a: Column, b: Column) -> Column:
    """What both hold; without width or height if that is nothing."""
    return between(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(a["x"] + a["w"], b["x"] + b["w"]), F.least(a["y"] + a["h"], b["y"] + b["h"]))


def united(a: Column, b: Column) -> Column:
    """The rectangle that holds both; an empty one adds nothing."""
    both = between(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"]))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def expanded(r: Column, by: int, width: int, height: int) -> Column:
    """Wider by `by` on all sides, as far as a picture of this size goes."""
    grown = rect(r["x"] - by, r["y"] - by, r["w"] + 2 * by, r["h"] + 2 * by)
    return F.get(F.transform(F.array(grown), lambda g: intersected(g, rect(*(F.lit(v) for v in (0, 0, width, height))))), F.lit(0))


def pixel_at(df: DataFrame, x: int, y: int) -> DataFrame:
    """The pixel at a place of each image that reaches there."""
    return df.filter((F.col("x") == x) & (F.col("y") == y))


def pixel_set(df: DataFrame, x: int, y: int, value: dict[str, int]) -> DataFrame:
    """Images with the channels of `value` at a place; images that don't reach there stay."""
    there = (F.col("x") == x) & (F.col("y") == y)
    return df.select([F.when(there, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in df.columns])


def blank(sizes: DataFrame, channels: int = 4) -> DataFrame:
    """Pixels of black images without alpha: sizes (image_id, width, height); of two channels or four, r, g, b, a, of three r, g, b, of one v."""
    rows = sizes.filter("width > 0 AND height > 0").select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    names = {1: "v", 3: "rgb"}.get(channels, "rgba")
    return rows.select("image_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[F.lit(0).alias(c) for c in names])


def masked_by_luma(df: DataFrame) -> DataFrame:
    """Alpha times the luma of the next image, in whole numbers of 54, 183 and 19 parts of 256, rounded."""
    luma = F.shiftright(F.col("t_r") * 54 + F.col("t_g") * 183 + F.col("t_b") * 19 + 128, 8)
    return pairs(df).select(*KEY, "r", "g", "b", F.floor((F.col("a") * luma + 127) / 255).cast("int").alias("a"))


def alpha_over(top: Column, below: Column, opacity: int) -> Column:
    """The alpha of one number over another, in whole numbers."""
    own = F.floor((top * opacity + 127) / 255)
    return F.least(own + F.floor((below * (255 - own) + 127) / 255), F.lit(255)).cast("int")


def mode_name(name: Column) -> Column:
    """The mode that a name means, whatever its case, with spaces, hyphens or nothing for underscores; unknown ones are normal."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s_-]", "")
    known = F.lit(None).cast("string")
    for mode in (*blend.MODES, *blend.WHOLE):
        known = F.when(plain == mode.replace("_", ""), mode).otherwise(known)
    return F.coalesce(known, F.lit("normal"))


def child_inserted(df: DataFrame, at: int, children: DataFrame) -> DataFrame:
    """Every parent with its new children (the columns of df but z) from place `at` on, or behind the last, in the order of their ids."""
    new = children.withColumn("z", F.lit(at)).withColumn("late", F.lit(0))
    old = df.withColumn("late", F.when(F.col("z") < at, -1).otherwise(1))
    return in_place(old.unionByName(new.select(old.columns)), "late", "z", "id").drop("late")


def rectangles(s, d) -> DataFrame:
    """id, a, b: the rectangles of layers and of their parents."""
    every = layers(s, d)
    own = rect(*(F.col(c) for c in SIDES))
    return every.select("id", "parent", own.alias("a")).join(every.select(F.col("id").alias("parent"), own.alias("b")), "parent").select("id", "a", "b")


def region_rows(s, d) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    both = rectangles(s, d).select("id", "a", "b", intersected(a, b).alias("i"), united(a, b).alias("u"), expanded(a, 3, 80, 60).alias("e"))
    parts = lambda n: [F.col(f"{n}.{k}").alias(f"{n}{k}") for k in SIDES]
    return both.select("id", *parts("i"), *parts("u"), *parts("e"), area(F.col("i")).cast("long").alias("area"), contains(a, b["x"], b["y"]).alias("holds"))


_AB = _LAYERS + ", p AS (SELECT l.id, l.x AS ax, l.y AS ay, l.w AS aw, l.h AS ah, q.x AS bx, q.y AS b_y, q.w AS bw, q.h AS bh FROM l JOIN l q ON q.id = l.parent)"
_I = {"x": "greatest(ax, bx)", "y": "greatest(ay, b_y)", "w": "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx))", "h": "greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y))"}
_EITHER = "CASE WHEN aw <= 0 OR ah <= 0 THEN {b} WHEN bw <= 0 OR bh <= 0 THEN {a} ELSE {u} END"
_U = {"x": ("ax", "bx", "least(ax, bx)"), "y": ("ay", "b_y", "least(ay, b_y)"), "w": ("aw", "bw", "greatest(ax + aw, bx + bw) - least(ax, bx)"), "h": ("ah", "bh", "greatest(ay + ah, b_y + bh) - least(ay, b_y)")}
_E = {"x": "greatest(0, ax - 3)", "y": "greatest(0, ay - 3)", "w": "greatest(0, least(80, ax + aw + 3) - greatest(0, ax - 3))", "h": "greatest(0, least(60, ay + ah + 3) - greatest(0, ay - 3))"}
_LONG = lambda v, n: f"CAST({v} AS BIGINT) AS {n}"
_REGIONS = _AB + " SELECT id, " + ", ".join([*[_LONG(v, "i" + k) for k, v in _I.items()], *[_LONG(_EITHER.format(a=a, b=b, u=u), "u" + k) for k, (a, b, u) in _U.items()], *[_LONG(v, "e" + k) for k, v in _E.items()]]) + f", {_LONG(_I['w'] + ' * ' + _I['h'], 'area')}, bx >= ax AND b_y >= ay AND bx < ax + aw AND b_y < ay + ah AS holds FROM p"
_NEW = "SELECT CAST(n_nationkey + 5000000 AS BIGINT) AS id, CAST(n_regionkey + 10 AS BIGINT) AS parent, n_nationkey AS x, n_nationkey AS y, 1 AS w, 2 AS h FROM nation"
_INSERTED = _LAYERS + f", n AS ({_NEW}), al AS (SELECT id, parent, x, y, w, h, z, CASE WHEN z < 2 THEN -1 ELSE 1 END AS late FROM l UNION ALL SELECT id, parent, x, y, w, h, 2, 0 FROM n) SELECT id, parent, x, y, w, h, " + _Z.format(o="late, z, id") + " FROM al"


def new_children(s, d) -> DataFrame:
    k = F.col("n_nationkey")
    return table(s, d, "nation").select((k + 5000000).cast("long").alias("id"), (F.col("n_regionkey") + 10).cast("long").alias("parent"), k.alias("x"), k.alias("y"), F.lit(1).alias("w"), F.lit(2).alias("h"))


_JOIN = "FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y"
_OWN = "((p.a * 90 + 127) // 255)"

OPS = {
    "regions": (region_rows, _REGIONS),
    "pixel_at": (lambda s, d: pixel_at(pixels(s, d), 3, 5), pick("* ", "px WHERE x = 3 AND y = 5")),
    "pixel_set": (lambda s, d: pixel_set(pixels(s, d), 2, 7, {"r": 9, "a": 0}), pick("image_id, x, y, CASE WHEN x = 2 AND y = 7 THEN 9 ELSE r END AS r, g, b, CASE WHEN x = 2 AND y = 7 THEN 0 ELSE a END AS a")),
    "blank_images": (
        lambda s, d: blank(table(s, d, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 5).cast("int").alias("width"), (F.col("s_suppkey") % 7).cast("int").alias("height"))),
        "SELECT s_suppkey AS image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM supplier, unnest(range(5)) AS u(x), unnest(range(7)) AS w(y) WHERE x < s_suppkey % 5 AND y < s_suppkey % 7"),
    "alpha_mask_by_luma": (lambda s, d: masked_by_luma(pixels(s, d)), f"{PX} SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, CAST((p.a * ((q.r * 54 + q.g * 183 + q.b * 19 + 128) >> 8) + 127) // 255 AS INTEGER) AS a {_JOIN}"),
    "alpha_over": (lambda s, d: pairs(pixels(s, d)).select(*KEY, alpha_over(F.col("a"), F.col("t_a"), 90).alias("a")), f"{PX} SELECT p.image_id, p.x, p.y, CAST(least(255, {_OWN} + (q.a * (255 - {_OWN}) + 127) // 255) AS INTEGER) AS a {_JOIN}"),
    "layer_inserted": (lambda s, d: child_inserted(layers(s, d), 2, new_children(s, d)), _INSERTED),
}
