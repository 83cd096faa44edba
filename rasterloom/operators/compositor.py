"""Trees of layers put together: pixel layers, groups and adjustments, with modes, opacity, masks and visibility.

A layer is a row.  Its samples are cut into rows of the canvas, and all siblings' samples of one canvas row meet in one
short array, in their order, where built-in functions fold them.  Groups are folded from the deepest up, each
over an empty canvas; its result is then a sample row like those of its siblings.  So a round of work, of which there
are as many as the tree is deep, is one group-by on (document, group, canvas row), and no document meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blend
from ..oracle import PX
from ..sources.kept import kept
from ..sources.tables import images
from .compositing import _SQL

#: What an adjustment can change, and the values that change nothing.
ADJUSTMENTS = {"brightness": 0.0, "contrast": 0.0, "saturation": 0.0, "hue": 0.0, "gamma": 1.0, "exposure": 0.0}
LAYER = ["doc", "id", "parent", "z", "kind", "mode", "opacity", "visible", "left", "top", "width", "height", "px", "mask", *ADJUSTMENTS]
#: Luma weights, and the matrices by which colours turn around gray (those of SVG's hueRotate).
WEIGHTS = (0.213, 0.715, 0.072)
TURN_COS = ((0.787, -0.715, -0.072), (-0.213, 0.285, -0.072), (-0.213, -0.715, 0.928))
TURN_SIN = ((-0.213, -0.715, 0.928), (0.143, 0.140, -0.283), (-0.787, 0.715, 0.072))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pixel(c: dict[str, Column]) -> Column:
    return F.struct(*[c[k].cast("int").alias(k) for k in "rgba"])


def parts(p: Column) -> dict[str, Column]:
    return {k: p[k] for k in "rgba"}


def adjusted(p: Column, share: Column, how: Callable[[str], Column]) -> Column:
    """A pixel changed by exposure, brightness, contrast, saturation, hue and gamma, in this order, as far as `share` (0..1) says.

    Alpha stays, and so do pixels without alpha.
    """
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    first = {k: ((p[k] / 255.0 * F.pow(F.lit(2.0), how("exposure")) + how("brightness")) - 0.5) * (how("contrast") + 1.0) + 0.5 for k in "rgb"}
    luma = lambda c: sum((c[k] * w for k, w in zip("gb", WEIGHTS[1:])), c["r"] * WEIGHTS[0])

    def coloured(c: Column) -> Column:
        gray = luma(c)
        return F.struct(*[(gray + (c[k] - gray) * (how("saturation") + 1.0)).alias(k) for k in "rgb"])

    def turned(c: Column) -> Column:
        cos, sin = F.cos(F.radians(how("hue"))), F.sin(F.radians(how("hue")))
        line = lambda i: sum(((F.lit(w) + cos * a + sin * b) * c[k] for k, w, a, b in zip("gb", WEIGHTS[1:], TURN_COS[i][1:], TURN_SIN[i][1:])), (F.lit(WEIGHTS[0]) + cos * TURN_COS[i][0] + sin * TURN_SIN[i][0]) * c["r"])
        return F.struct(*[line(i).alias(k) for i, k in enumerate("rgb")])

    def byte(old: Column, new: Column) -> Column:
        value = old / 255.0 + (F.pow(unit(new), F.lit(1.0) / how("gamma")) - old / 255.0) * share
        return F.floor(F.round(unit(value) * 255.0 + 0.5, 6))

    done = let(let(F.struct(*[v.alias(k) for k, v in first.items()]), coloured), turned)
    return let(done, lambda c: F.when(p["a"] > 0, pixel({k: byte(p[k], c[k]) for k in "rgb"} | {"a": p["a"]})).otherwise(p))


def laid_over(canvas: Column, layer: Column) -> Column:
    """A canvas row with one more layer on it; samples that the layer doesn't have are null."""
    how = lambda name: F.coalesce(layer[name], F.lit(ADJUSTMENTS[name]))
    change = lambda p, q: F.when(q.isNull(), p).otherwise(adjusted(p, q["a"] / 255.0 * layer["opacity"], how))
    cover = lambda p, q: F.when(q.isNull(), p).otherwise(blend.over(layer["mode"], parts(p), parts(q), layer["opacity"]))
    return F.when(layer["kind"] == "adjustment", F.zip_with(canvas, layer["strip"], change)).otherwise(F.zip_with(canvas, layer["strip"], cover))


def strips(width: int | Column, y: Column) -> Column:
    """A layer's samples in canvas row y: width structs, null where it has none, alpha times the mask.

    An adjustment without a size covers the canvas; one without a mask has full shares.
    """
    at = lambda x: (y - F.col("top")) * F.col("width") + x - F.col("left")
    inside = lambda x: (y >= F.col("top")) & (y < F.col("top") + F.col("height")) & (x >= F.col("left")) & (x < F.col("left") + F.col("width"))
    share = lambda x: F.when(F.col("mask").isNull(), 255).otherwise(F.coalesce(F.get("mask", at(x)), F.lit(0)))
    through = lambda a, x: F.floor((a * share(x) + 127) / 255)
    own = lambda x: F.when(inside(x), let(F.get("px", at(x)), lambda p: F.when(p.isNotNull(), pixel({k: p[k] for k in "rgb"} | {"a": through(p["a"], x)}))))
    blank = {k: F.lit(255) for k in "rgb"}
    whole = F.col("width").isNull()
    effect = lambda x: F.when(whole | inside(x), pixel(blank | {"a": F.when(whole, 255).otherwise(share(x))}))
    last = width - 1 if isinstance(width, Column) else F.lit(width - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda x: F.when(F.col("kind") == "adjustment", effect(x)).otherwise(own(x)))


def depths(layers: DataFrame) -> DataFrame:
    """The visible layers of which all groups above are visible, with their depth (0: on the canvas)."""
    visible = layers.filter("visible")
    wave = kept(visible.filter("parent IS NULL").withColumn("depth", F.lit(0)))
    found = wave
    while True:
        groups = wave.filter("kind = 'group'").select("doc", F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"))
        wave = kept(visible.join(groups, ["doc", "parent"]).select(wave.columns))
        if wave.isEmpty():
            return found
        found = found.unionByName(wave)


def composite(layers: DataFrame, width: int, height: int, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """doc, y, strip (structs of r, g, b, a): the canvas of each document, or a region (x, y, width, height) of it.

    layers: rows of LAYER.  kind is pixel, group or adjustment; px, of pixel layers alone, holds structs r, g, b, a row by
    row, and mask a number for each of them, 0 where it is too short.  A layer whose parent is null lies on the canvas; one
    under a missing or hidden group doesn't show.  Layers that share a parent and a z come in the order of their ids.
    Documents of which nothing shows have empty canvases.
    """
    first, count = (region[1], region[3]) if region else (0, height)
    rows = F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("y")
    shown = depths(layers)
    deepest = shown.agg(F.max("depth")).first()[0] or 0
    how = ["doc", "parent", "depth", "id", "z", "kind", "mode", "opacity", *ADJUSTMENTS]
    leaves = shown.filter("kind <> 'group'").select("*", rows)
    leaves = leaves.select(*how, "y", strips(width, F.col("y")).alias("strip"))
    empty = F.array_repeat(F.struct(*[F.lit(0).alias(k) for k in "rgba"]), width)
    one = F.struct("z", "id", "kind", "mode", F.col("opacity").cast("double").alias("opacity"), *ADJUSTMENTS, "strip")
    folded = F.aggregate("l", empty, laid_over).alias("strip")
    results = None
    for depth in range(deepest, -1, -1):
        level = leaves.filter(F.col("depth") == depth)
        if results is not None:
            groups = shown.filter((F.col("kind") == "group") & (F.col("depth") == depth)).select(*how)
            level = level.unionByName(groups.join(results.withColumnRenamed("parent", "id"), ["doc", "id"]))
        meet = level.groupBy("doc", "parent", "y").agg(F.sort_array(F.collect_list(one)).alias("l"))
        results = kept(meet.select("doc", "parent", "y", folded))
    every = layers.select("doc").distinct().select("doc", rows)
    full = every.join(results.drop("parent"), ["doc", "y"], "left").select("doc", "y", F.coalesce("strip", empty).alias("strip"))
    return full.withColumn("strip", F.slice("strip", region[0] + 1, region[2])) if region else full


BLANK = {k: 0 for k in "rgba"}


def flattened(layers: DataFrame) -> DataFrame:
    """doc, parent, left, y, strip: the direct children of each group in one image that just holds them.

    Visible pixel layers with samples count, from the lowest up, with their masks; groups within a group and adjustments
    don't.  A group of which nothing counts is one empty sample at its own place (0, 0 if it has none).
    """
    content = layers.filter("kind = 'pixel' AND visible AND px IS NOT NULL AND width > 0 AND height > 0 AND parent IS NOT NULL")
    box = content.groupBy("doc", "parent").agg(F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"))
    groups = layers.filter("kind = 'group'").select("doc", F.col("id").alias("parent"), F.coalesce("left", F.lit(0)).alias("own_x"), F.coalesce("top", F.lit(0)).alias("own_y"))
    size = groups.join(box, ["doc", "parent"], "left").select(
        "doc", "parent", F.coalesce("x0", "own_x").alias("x0"), F.coalesce("y0", "own_y").alias("y0"), F.coalesce(F.col("x1") - F.col("x0"), F.lit(1)).alias("w"), F.coalesce(F.col("y1") - F.col("y0"), F.lit(1)).alias("h"))
    rows = size.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    own = content.join(size, ["doc", "parent"]).withColumns({"left": F.col("left") - F.col("x0"), "top": F.col("top") - F.col("y0")})
    spread = own.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    cut = spread.select("doc", "parent", "y", "z", "id", "kind", "mode", "opacity", *ADJUSTMENTS, strips(F.col("w"), F.col("y")).alias("strip"))
    one = F.struct("z", "id", "kind", "mode", F.col("opacity").cast("double").alias("opacity"), *ADJUSTMENTS, "strip")
    meet = rows.join(cut.groupBy("doc", "parent", "y").agg(F.sort_array(F.collect_list(one)).alias("l")), ["doc", "parent", "y"], "left")
    empty = F.array_repeat(F.struct(*[F.lit(v).alias(k) for k, v in BLANK.items()]), F.col("w"))
    return meet.select("doc", "parent", F.col("x0").alias("left"), (F.col("y0") + F.col("y")).alias("y"), F.when(F.col("l").isNull(), empty).otherwise(F.aggregate("l", empty, laid_over)).alias("strip"))


def merged_down(layers: DataFrame, at: int) -> DataFrame:
    """doc, parent, left, y, strip: of each group the child at place `at` on the one below it, in one image that holds both.

    The one below brings its samples alone; whether either shows doesn't matter.  Groups without such a pair, or whose upper
    layer has no samples (it would just go), give no rows.
    """
    if at < 1:
        raise ValueError("the lowest layer has none below it")
    order = Window.partitionBy("doc", "parent").orderBy("z", "id")
    placed = layers.filter("parent IS NOT NULL").withColumn("place", F.row_number().over(order) - 1).filter(F.col("place").isin(at - 1, at))
    below = F.col("place") == at - 1
    pair = placed.withColumns({
        "mode": F.when(below, "normal").otherwise(F.col("mode")), "opacity": F.when(below, 1.0).otherwise(F.col("opacity")), "mask": F.when(~below, F.col("mask")), "visible": F.lit(True), "z": F.col("place")})
    upper = pair.filter((F.col("place") == at) & (F.col("kind") == "pixel") & F.col("px").isNotNull()).select("doc", "parent")
    groups = layers.filter("kind = 'group'").join(upper.withColumnRenamed("parent", "id"), ["doc", "id"], "left_semi")
    return flattened(pair.drop("place").join(upper, ["doc", "parent"], "left_semi").select(layers.columns).filter("kind = 'pixel'").unionByName(groups.select(layers.columns)))


def flat_pixels(flat: DataFrame) -> DataFrame:
    return flat.select("doc", "parent", "left", "y", F.posexplode("strip").alias("i", "p")).select("doc", "parent", (F.col("left") + F.col("i")).alias("x"), "y", "p.*")


def canvas_pixels(canvas: DataFrame, left: int = 0) -> DataFrame:
    return canvas.select("doc", F.posexplode("strip").alias("x", "p"), "y").select("doc", (F.col("x") + left).alias("x"), "y", "p.*")


WIDTH = HEIGHT = 10
#: The trees of the queries: the images of six rows of the table in groups within groups; (id, parent, z, mode, opacity, left, top) of each.
LEAVES = ((1, None, 0, "normal", 1.0, 0, 0), (3, 2, 0, "normal", 0.9, 2, 1), (4, 2, 1, "screen", 0.5, -3, 4), (6, 5, 0, "hard_light", 0.8, 4, -2), (7, 5, 1, "difference", 1.0, 1, 3), (9, None, 3, "soft_light", 0.6, 0, 2))
GROUPS = ((2, None, 1, "multiply", 0.7), (5, 2, 2, "normal", 0.75))
ADJUST = (8, None, 2, 0.8, {"brightness": 0.1, "contrast": 0.2, "saturation": -0.3, "hue": 40.0, "gamma": 1.2, "exposure": 0.3})
MASKED = 4


def trees(s, d) -> DataFrame:
    turn = lambda k: F.concat(F.slice("v", k + 1, 64), F.slice("v", 1, k))
    place = F.sequence(F.lit(0), F.lit(63))
    ims = images(s, d).select("image_id", "width", "height", F.col("v").alias("r"), turn(21).alias("g"), turn(42).alias("b"), F.transform(place, lambda i: (i * 37 % 256).cast("int")).alias("a"))
    fixed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(("id", "parent", "z", "mode", "opacity", "left", "top"), leaf, ("int", "int", "int", "string", "double", "int", "int"))]) for leaf in LEAVES])
    doc = F.floor(F.col("image_id") / len(LEAVES))
    none = [F.lit(v).alias(k) for k, v in ADJUSTMENTS.items()]
    leaves = ims.select("*", F.get(fixed, (F.col("image_id") % len(LEAVES)).cast("int")).alias("l")).select(
        doc.alias("doc"), "l.id", "l.parent", "l.z", F.lit("pixel").alias("kind"), "l.mode", "l.opacity", ((F.col("l.id") != 9) | (doc % 2 == 0)).alias("visible"), "l.left", "l.top",
        "width", "height", F.arrays_zip(*"rgba").alias("px"), F.when(F.col("l.id") == MASKED, F.col("b")).alias("mask"), *none)
    no = lambda name: F.lit(None).cast(dict(leaves.dtypes)[name]).alias(name)
    docs = leaves.select("doc").distinct()
    row = lambda id_, parent, z, kind, mode, opacity, how: docs.select(
        "doc", F.lit(id_).alias("id"), F.lit(parent).cast("int").alias("parent"), F.lit(z).alias("z"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.lit(opacity).alias("opacity"), F.lit(True).alias("visible"),
        *map(no, ("left", "top", "width", "height", "px", "mask")), *[F.lit(v).alias(k) for k, v in (ADJUSTMENTS | how).items()])
    for g in GROUPS:
        leaves = leaves.unionByName(row(*g[:3], "group", *g[3:], {}))
    return leaves.unionByName(row(*ADJUST[:3], "adjustment", "normal", ADJUST[3], ADJUST[4]))


def _over(mode: str, opacity: float, below: str, above: str, mask: str = "") -> str:
    """A step of the SQL: relation `above` over relation `below`, both of doc, x, y, r, g, b, a."""
    alpha = f"((q.a * {mask} + 127) // 255)" if mask else "q.a"
    at, ab = f"({alpha} / CAST(255 AS DOUBLE) * {opacity})", "(p.a / CAST(255 AS DOUBLE))"
    ao = f"({at} + {ab} * (1 - {at}))"
    byte = lambda v: f"CAST(floor(round(least(1, greatest(0, {v})) * 255 + 0.5, 6)) AS INTEGER)"

    def of(c: str) -> str:
        b, s = f"(p.{c} / CAST(255 AS DOUBLE))", f"(q.{c} / CAST(255 AS DOUBLE))"
        mixed = f"({at} * ({_SQL[mode].format(b=b, s=s)}) + {ab} * {b} * (1 - {at})) / nullif({ao}, 0)" if c != "a" else ao
        return f"CASE WHEN q.a IS NULL OR {at} <= 0 THEN p.{c} ELSE {byte(mixed)} END AS {c}"

    return f"(SELECT p.doc, p.x, p.y, {', '.join(map(of, 'rgba'))} FROM {below} p LEFT JOIN {above} q USING (doc, x, y))"


def _adjust(below: str) -> str:
    how = ADJUST[4]
    one = lambda c: f"(({c} / CAST(255 AS DOUBLE) * pow(2, {how['exposure']}) + {how['brightness']}) - 0.5) * {1 + how['contrast']} + 0.5"
    more = 1 + how["saturation"]
    co, si = cos(radians(how["hue"])), sin(radians(how["hue"]))
    line = lambda i: " + ".join(f"({w} + {co} * {a} + {si} * {b}) * s{k}" for k, w, a, b in zip("rgb", WEIGHTS, TURN_COS[i], TURN_SIN[i]))
    gray = " + ".join(f"e{k} * {w}" for k, w in zip("rgb", WEIGHTS))
    value = lambda k: f"least(1, greatest(0, {k} / CAST(255 AS DOUBLE) + (pow(least(1, greatest(0, t{k})), {1 / how['gamma']}) - {k} / CAST(255 AS DOUBLE)) * {ADJUST[3]}))"
    out = ", ".join(f"CASE WHEN a > 0 THEN CAST(floor(round({value(k)} * 255 + 0.5, 6)) AS INTEGER) ELSE {k} END AS {k}" for k in "rgb")
    return (f"(SELECT doc, x, y, {out}, a FROM (SELECT *, {', '.join(f'{line(i)} AS t{k}' for i, k in enumerate('rgb'))} FROM (SELECT *, {', '.join(f'gr + (e{k} - gr) * {more} AS s{k}' for k in 'rgb')} "
            f"FROM (SELECT *, {gray} AS gr FROM (SELECT *, {', '.join(f'{one(k)} AS e{k}' for k in 'rgb')} FROM {below})))))")


def _trees_sql(where: str = "") -> str:
    at = {leaf[0]: (i, *leaf[5:]) for i, leaf in enumerate(LEAVES)}
    layer = lambda n: f"(SELECT image_id // 6 AS doc, x + {at[n][1]} AS x, y + {at[n][2]} AS y, r, g, b, a FROM px WHERE image_id % 6 = {at[n][0]}" + (" AND image_id // 6 % 2 = 0)" if n == 9 else ")")
    how = {leaf[0]: leaf[3:5] for leaf in LEAVES} | {g[0]: g[3:5] for g in GROUPS}
    step = lambda n, below, above="", mask="": _over(*how[n], below, above or layer(n), mask)
    return f"""{PX}, t AS (SELECT doc, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM (SELECT DISTINCT vec_id // 6 AS doc FROM embeddings), unnest(range({WIDTH})) AS u(x), unnest(range({HEIGHT})) AS w(y)),
g5 AS {step(7, step(6, 't'))}, g2 AS {step(5, step(4, step(3, 't'), mask='q.b'), 'g5')},
c AS {step(9, _adjust(step(2, step(1, 't'), 'g2')))} SELECT doc, x, y, r, g, b, a FROM c {where}"""


def _flat_sql(steps: dict[int, tuple]) -> str:
    """steps: of each group its leaves, as (id, mode, opacity, mask)."""
    at = {leaf[0]: (i, *leaf[5:]) for i, leaf in enumerate(LEAVES)}
    layer = lambda n: f"(SELECT image_id // 6 AS doc, x + {at[n][1]} AS x, y + {at[n][2]} AS y, r, g, b, a FROM px WHERE image_id % 6 = {at[n][0]})"
    out, parts = [], []
    for group, leaves in steps.items():
        shown = " UNION ALL ".join(f"SELECT doc, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {layer(n)} GROUP BY doc" for n, *_ in leaves)
        parts.append(f"bo{group} AS (SELECT d.doc, coalesce(min(x0), 0) AS x0, coalesce(max(x1), 0) AS x1, coalesce(min(y0), 0) AS y0, coalesce(max(y1), 0) AS y1 FROM (SELECT DISTINCT vec_id // 6 AS doc FROM embeddings) d LEFT JOIN ({shown}) s ON s.doc = d.doc GROUP BY d.doc)")
        parts.append(f"t{group} AS (SELECT doc, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM bo{group}, unnest(range(-9, 20)) AS u(x), unnest(range(-9, 20)) AS w(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
        canvas = f"t{group}"
        for n, mode, opacity, mask in leaves:
            canvas = _over(mode, opacity, canvas, layer(n), mask)
        out.append(f"SELECT doc, {group} AS parent, x, y, r, g, b, a FROM {canvas}")
    return f"{PX}, {', '.join(parts)} " + " UNION ALL ".join(out)


_HOW = {leaf[0]: leaf[3:5] for leaf in LEAVES}

OPS = {
    "layers_flattened": (lambda s, d: flat_pixels(flattened(trees(s, d))), _flat_sql({2: ((3, *_HOW[3], ""), (4, *_HOW[4], "q.b")), 5: ((6, *_HOW[6], ""), (7, *_HOW[7], ""))})),
    "layer_pixels_merged": (
        lambda s, d: flat_pixels(merged_down(trees(s, d), 1)),
        "SELECT * FROM (" + _flat_sql({2: ((3, "normal", 1.0, ""), (4, *_HOW[4], "q.b")), 5: ((6, "normal", 1.0, ""), (7, *_HOW[7], ""))}) + ") WHERE (parent = 2 AND doc * 6 + 2 IN (SELECT vec_id FROM embeddings)) OR (parent = 5 AND doc * 6 + 4 IN (SELECT vec_id FROM embeddings))"),
    "composite_tree": (lambda s, d: canvas_pixels(composite(trees(s, d), WIDTH, HEIGHT)), _trees_sql()),
    "composite_region": (lambda s, d: canvas_pixels(composite(trees(s, d), WIDTH, HEIGHT, (3, 2, 5, 4)), 3), _trees_sql("WHERE x BETWEEN 3 AND 7 AND y BETWEEN 2 AND 5")),
}
