"""Palettes of many images at once, quantizing by colour counts, ordered dithering, and sheets of sprites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..oracle import PX, pick
from ..sources.tables import KEY, SIDE, pixels

RGB = ["r", "g", "b"]


def colors_of(df: DataFrame) -> DataFrame:
    """Each image's different colours and how often it has them; rows are combined before the shuffle."""
    return df.groupBy("image_id", *RGB).agg(F.count("*").alias("n"))


def luminance() -> Column:
    return F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114


def by_luminance(df: DataFrame) -> DataFrame:
    """The different colours of each image, from dark to light."""
    order = Window.partitionBy("image_id").orderBy(luminance(), *RGB)
    return colors_of(df).withColumn("place", F.row_number().over(order))


def by_frequency(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), *RGB)
    return colors_of(df).withColumn("place", F.row_number().over(order))


def median_cut(df: DataFrame, rounds: int = 3) -> DataFrame:
    """Each image's boxes of colours after so many halvings: box, its number of pixels and its mean colour (whole).

    In a round every box is cut across its widest channel (the first of equals) at the weighted median: a colour is
    in the upper half if the pixels before it, in the order of that channel and then of all, are at least half.  A
    box of one colour stays as it is.  Images are apart, so a round is two windows over the different colours.
    """
    boxes = colors_of(df).withColumn("box", F.lit(0).cast("long"))
    for _ in range(rounds):
        box = Window.partitionBy("image_id", "box")
        spans = {c: F.max(c).over(box) - F.min(c).over(box) for c in RGB}
        ranged = boxes.withColumns({f"span_{c}": v for c, v in spans.items()})
        widest = F.greatest(*[F.col(f"span_{c}") for c in RGB])
        value = F.when(F.col("span_r") == widest, F.col("r")).when(F.col("span_g") == widest, F.col("g")).otherwise(F.col("b"))
        placed = ranged.withColumn("value", value)
        order = box.orderBy("value", *RGB)
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        upper = (before * 2 >= F.sum("n").over(box)) & (widest > 0)
        boxes = placed.withColumn("box", F.col("box") * 2 + upper.cast("long")).select("image_id", *RGB, "n", "box")
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c)
    return boxes.groupBy("image_id", "box").agg(F.sum("n").alias("n"), *[mean(c) for c in RGB])


def octree(df: DataFrame, depth: int = 2) -> DataFrame:
    """Each image's leaves at a depth of the tree over the channels' bits, from the highest: leaf, pixels, mean colour."""
    leaf = F.lit(0)
    for bit in range(7, 7 - depth, -1):
        for c in RGB:
            leaf = leaf * 2 + F.expr(f"shiftright({c}, {bit}) & 1")
    counted = colors_of(df).withColumn("leaf", leaf.cast("int"))
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c)
    return counted.groupBy("image_id", "leaf").agg(F.sum("n").alias("n"), *[mean(c) for c in RGB])


def bayer(size: int) -> list[list[int]]:
    """The matrix of ordered dithering of 2, 4, 8, ...: each is made of four of the one before."""
    if size == 1:
        return [[0]]
    half = bayer(size // 2)
    part = lambda x, y: half[y % (size // 2)][x % (size // 2)] * 4 + ((0, 2), (3, 1))[y // (size // 2)][x // (size // 2)]
    return [[part(x, y) for x in range(size)] for y in range(size)]


def ordered_dither(df: DataFrame, size: int = 4) -> DataFrame:
    """Gray (whole luminance) against the matrix at the pixel's place: 255 where it is over the threshold, else 0."""
    matrix = F.lit([v for row in bayer(size) for v in row])
    threshold = (F.get(matrix, (F.col("y") % size) * size + F.col("x") % size) * 2 + 1) * 255
    gray = F.floor(luminance() / 1000)
    return df.select(*KEY, F.when(gray * (2 * size * size) > threshold, 255).otherwise(0).alias("v"))


def sheet_size(count: int, width: int, height: int, columns: int, gap: int = 0) -> tuple[int, int]:
    rows = -(-count // columns)
    return columns * width + (columns - 1) * gap, rows * height + (rows - 1) * gap


def sheet(df: DataFrame, per_sheet: int = 16, columns: int = 4, gap: int = 1) -> DataFrame:
    """Images laid out row by row on sheets: sheet, x, y and the channels.  A projection: no row meets another."""
    frame = F.pmod(F.col("image_id"), F.lit(per_sheet))
    return df.select(
        F.floor(F.col("image_id") / per_sheet).alias("sheet"),
        (F.col("x") + (frame % columns) * (SIDE + gap)).cast("int").alias("x"),
        (F.col("y") + F.floor(frame / columns) * (SIDE + gap)).cast("int").alias("y"), *RGB, "a")


def from_sheet(df: DataFrame, per_sheet: int = 16, columns: int = 4, gap: int = 1) -> DataFrame:
    """The images of sheets; what lies in the gaps is left out."""
    step = SIDE + gap
    inside = (F.col("x") % step < SIDE) & (F.col("y") % step < SIDE)
    frame = F.floor(F.col("y") / step) * columns + F.floor(F.col("x") / step)
    return df.filter(inside).select((F.col("sheet") * per_sheet + frame).cast("long").alias("image_id"), (F.col("x") % step).alias("x"), (F.col("y") % step).alias("y"), *RGB, "a")


def reduced(df: DataFrame, keep: int = 8) -> DataFrame:
    """Pixels in the `keep` commonest colours of their image: each takes the nearest of these, the commonest of equals."""
    chosen = by_frequency(df).filter(F.col("place") <= keep)
    table = chosen.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", *RGB))).alias("palette"))  # at most `keep` for each image
    apart = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "gb"), (F.col("r") - p["r"]) * (F.col("r") - p["r"]))
    best = F.array_min(F.transform("palette", lambda p: F.struct(apart(p).alias("d"), p["place"].alias("place"), *[p[c].alias(c) for c in RGB])))
    return df.join(table, "image_id").select(*KEY, best.alias("best")).select(*KEY, *[F.col(f"best.{c}").alias(c) for c in RGB])


_COUNTED = ", co AS (SELECT image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL)"
_MEANS = ", ".join(f"CAST(sum({c} * n) // sum(n) AS INTEGER) AS {c}" for c in RGB)


def _cut_sql(rounds: int) -> str:
    sql, last = PX + _COUNTED + ", b0 AS (SELECT *, 0 AS box FROM co)", "b0"
    for k in range(1, rounds + 1):
        sql += f""", s{k} AS (SELECT *, max(r) OVER w - min(r) OVER w AS sr, max(g) OVER w - min(g) OVER w AS sg, max(b) OVER w - min(b) OVER w AS sb, sum(n) OVER w AS whole FROM {last} WINDOW w AS (PARTITION BY image_id, box)),
v{k} AS (SELECT *, greatest(sr, sg, sb) AS span, CASE WHEN sr = greatest(sr, sg, sb) THEN r WHEN sg = greatest(sr, sg, sb) THEN g ELSE b END AS value FROM s{k}),
o{k} AS (SELECT *, sum(n) OVER (PARTITION BY image_id, box ORDER BY value, r, g, b) - n AS ahead FROM v{k}),
b{k} AS (SELECT image_id, r, g, b, n, box * 2 + CASE WHEN ahead * 2 >= whole AND span > 0 THEN 1 ELSE 0 END AS box FROM o{k})"""
        last = f"b{k}"
    return sql + f" SELECT image_id, CAST(box AS BIGINT) AS box, CAST(sum(n) AS BIGINT) AS n, {_MEANS} FROM {last} GROUP BY image_id, box"


_LUM = "(r * 299 + g * 587 + b * 114)"
_BAYER = "[0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]"
_RANKED = PX + _COUNTED + ", ra AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS place FROM co)"

OPS = {
    "palette_by_luminance": (lambda s, d: by_luminance(pixels(s, d)), PX + _COUNTED + f" SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY {_LUM}, r, g, b) AS INTEGER) AS place FROM co"),
    "palette_by_frequency": (lambda s, d: by_frequency(pixels(s, d)), _RANKED + " SELECT * FROM ra"),
    "palette_deduplicated": (lambda s, d: pixels(s, d).dropDuplicates(["image_id", *RGB]).select("image_id", *RGB), pick("DISTINCT image_id, r, g, b")),
    "palette_reduced": (lambda s, d: reduced(pixels(s, d)), _RANKED + ", di AS (SELECT p.image_id, p.x, p.y, q.r, q.g, q.b, row_number() OVER (PARTITION BY p.image_id, p.x, p.y ORDER BY (p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b), q.place) AS k FROM px p JOIN ra q ON q.image_id = p.image_id AND q.place <= 8) SELECT image_id, x, y, r, g, b FROM di WHERE k = 1"),
    "median_cut": (lambda s, d: median_cut(pixels(s, d)), _cut_sql(3)),
    "octree": (lambda s, d: octree(pixels(s, d)), PX + _COUNTED + f", le AS (SELECT *, ((r >> 7) & 1) * 32 + ((g >> 7) & 1) * 16 + ((b >> 7) & 1) * 8 + ((r >> 6) & 1) * 4 + ((g >> 6) & 1) * 2 + ((b >> 6) & 1) AS leaf FROM co) SELECT image_id, CAST(leaf AS INTEGER) AS leaf, CAST(sum(n) AS BIGINT) AS n, {_MEANS} FROM le GROUP BY image_id, leaf"),
    "ordered_dither": (lambda s, d: ordered_dither(pixels(s, d)), pick(f"image_id, x, y, CASE WHEN ({_LUM} // 1000) * 32 > ({_BAYER}[(y % 4) * 4 + x % 4 + 1] * 2 + 1) * 255 THEN 255 ELSE 0 END AS v")),
    "sprite_sheet": (lambda s, d: sheet(pixels(s, d)), pick("image_id // 16 AS sheet, CAST(x + (image_id % 4) * 9 AS INTEGER) AS x, CAST(y + (image_id % 16 // 4) * 9 AS INTEGER) AS y, r, g, b, a")),
    "sprites_extracted": (lambda s, d: from_sheet(sheet(pixels(s, d))), pick("image_id, x, y, r, g, b, a")),
}
