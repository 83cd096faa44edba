"""Two images or more at one place: positional joins, blending, layers from bottom to top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blend
from ..oracle import PX
from ..sources.tables import pixels

SIDES = {"base": "", "top": "t_"}


def pairs(df: DataFrame, step: int = 1, dx: int = 0, dy: int = 0, how: str = "inner") -> DataFrame:
    """Each image with the one `step` further on, shifted by (dx, dy): its channels are named t_*."""
    other = df.select((F.col("image_id") - step).alias("image_id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(c).alias(f"t_{c}") for c in "rgba"])
    return df.join(other, ["image_id", "x", "y"], how)


def sides(df: DataFrame) -> tuple[dict, dict]:
    return tuple({c: F.col(f"{p}{c}") for c in "rgba"} for p in SIDES.values())


def blended(df: DataFrame, mode: str, opacity: float = 1.0) -> DataFrame:
    base, top = sides(df)
    return df.select("image_id", "x", "y", blend.over(mode, base, top, opacity).alias("o")).select("image_id", "x", "y", "o.*")


def region(df: DataFrame, dx: int, dy: int, mode: str, opacity: float) -> DataFrame:
    """The next image over this one, shifted; pixels that it doesn't cover stay."""
    joined = pairs(df, dx=dx, dy=dy, how="left")
    base, top = sides(joined)
    mixed = blend.over(mode, base, {k: F.coalesce(v, F.lit(0)) for k, v in top.items()}, opacity)
    own = F.struct(*[base[k].cast("int").alias(k) for k in "rgba"])
    return joined.select("image_id", "x", "y", F.when(F.col("t_a").isNull(), own).otherwise(mixed).alias("o")).select("image_id", "x", "y", "o.*")


def masked(df: DataFrame) -> DataFrame:
    """Alpha times the mask's alpha."""
    return pairs(df).select("image_id", "x", "y", "r", "g", "b", F.floor((F.col("a") * F.col("t_a") + 127) / 255).cast("int").alias("a"))


def anaglyph(df: DataFrame) -> DataFrame:
    return pairs(df).select("image_id", "x", "y", "r", F.col("t_g").alias("g"), F.col("t_b").alias("b"), "a")


def flatten(df: DataFrame, n: int = 3) -> DataFrame:
    """Stacks of n layers (an image and those after it), blended in whole numbers from the bottom up.

    The layers of a pixel meet in one short array, in the order of z, and are folded there.
    """
    deal = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    layers = df.withColumn("z", deal).withColumn("image_id", F.col("image_id") - F.col("z"))
    full = layers.groupBy("image_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "a"))).alias("l")).filter(F.size("l") == n)
    part = lambda s: {c: s[c] for c in "rgba"}
    fold = F.aggregate(F.slice("l", 2, n), F.get("l", F.lit(0)), lambda a, t: F.struct(t["z"].alias("z"), *[v.alias(k) for k, v in blend.over_whole_numbers(part(a), part(t), 200).items()]))
    return full.select("image_id", "x", "y", fold.alias("o")).select("image_id", "x", "y", *[F.col(f"o.{c}").alias(c) for c in "rgba"])


# The same in SQL; p is the base and q the top.

_U = {"b": "(p.{c} / CAST(255 AS DOUBLE))", "s": "(q.{c} / CAST(255 AS DOUBLE))"}
_SQL = {
    "normal": "{s}", "multiply": "{b} * {s}", "screen": "1 - (1 - {b}) * (1 - {s})", "overlay": "CASE WHEN {b} < 0.5 THEN 2 * {b} * {s} ELSE 1 - 2 * (1 - {b}) * (1 - {s}) END",
    "darken": "least({b}, {s})", "lighten": "greatest({b}, {s})", "color_dodge": "CASE WHEN {b} <= 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {b} / (1 - {s})) END",
    "color_burn": "CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least(1, (1 - {b}) / {s}) END", "hard_light": "CASE WHEN {s} < 0.5 THEN 2 * {b} * {s} ELSE 1 - 2 * (1 - {b}) * (1 - {s}) END",
    "soft_light": "CASE WHEN {s} <= 0.5 THEN {b} - (1 - 2 * {s}) * {b} * (1 - {b}) ELSE {b} + (2 * {s} - 1) * (CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END - {b}) END",
    "difference": "abs({b} - {s})", "exclusion": "{b} + {s} - 2 * {b} * {s}",
}
_JOIN = "FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y"


def _sql_blend(mode: str, opacity: float, join: str = _JOIN, missing: str = "") -> str:
    at, ab = f"(q.a / CAST(255 AS DOUBLE) * {opacity})", "(p.a / CAST(255 AS DOUBLE))"
    ao = f"({at} + {ab} * (1 - {at}))"
    byte = lambda v: f"CAST(floor(round(least(1, greatest(0, {v})) * 255 + 0.5, 6)) AS INTEGER)"

    def of(c: str) -> str:
        b, s = _U["b"].format(c=c), _U["s"].format(c=c)
        mixed = f"({at} * ({_SQL[mode].format(b=b, s=s)}) + {ab} * {b} * (1 - {at})) / nullif({ao}, 0)" if c != "a" else ao
        return f"CASE WHEN {missing}{at} <= 0 THEN p.{c} ELSE {byte(mixed)} END AS {c}"

    return f"{PX} SELECT p.image_id, p.x, p.y, {', '.join(map(of, 'rgba'))} {join}"


_LEFT = "FROM px p LEFT JOIN px q ON q.image_id = p.image_id + 1 AND q.x + 2 = p.x AND q.y - 1 = p.y"


def _step(n: int, below: str) -> str:
    at, wb = "((q.a * 200 + 127) // 255)", "((p.a * (255 - (q.a * 200 + 127) // 255) + 127) // 255)"
    mix = lambda c: f"CAST(CASE WHEN {at} = 0 THEN p.{c} WHEN {at} = 255 THEN q.{c} WHEN {at} + {wb} = 0 THEN 0 ELSE " + (f"least({at} + {wb}, 255)" if c == "a" else f"(q.{c} * {at} + p.{c} * {wb} + ({at} + {wb}) // 2) // greatest({at} + {wb}, 1)") + f" END AS INTEGER) AS {c}"
    return f"SELECT p.image_id, p.x, p.y, {', '.join(map(mix, 'rgba'))} FROM {below} p JOIN px q ON q.image_id = p.image_id + {n} AND q.x = p.x AND q.y = p.y"


OPS = {
    **{f"blend_{m}": (lambda s, d, m=m: blended(pairs(pixels(s, d)), m, 0.75), _sql_blend(m, 0.75)) for m in blend.MODES},
    **{f"blend_{m}": (lambda s, d, m=m: blended(pairs(pixels(s, d)), m, 0.75), None) for m in blend.WHOLE},
    "blend_region": (lambda s, d: region(pixels(s, d), 2, -1, "screen", 0.5), _sql_blend("screen", 0.5, _LEFT, "q.a IS NULL OR ")),
    "alpha_mask": (lambda s, d: masked(pixels(s, d)), f"{PX} SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, CAST((p.a * q.a + 127) // 255 AS INTEGER) AS a {_JOIN}"),
    "anaglyph": (lambda s, d: anaglyph(pixels(s, d)), f"{PX} SELECT p.image_id, p.x, p.y, p.r, q.g, q.b, p.a {_JOIN}"),
    "flatten_layers": (lambda s, d: flatten(pixels(s, d)), f"{PX}, one AS ({_step(1, 'px')}) {_step(2, 'one')}"),
}
