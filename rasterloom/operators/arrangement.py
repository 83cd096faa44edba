"""Palettes, tiles with halos, shifted channels, filled rectangles, and images from formulas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..oracle import PX
from ..sources.tables import KEY, SIDE, pixels, table

#: Fixed value: a palette of sixteen.
PALETTE = tuple((r * (170 if not hi else 255), g * (170 if not hi else 255), b * (170 if not hi else 255)) for hi in (0, 1) for r in (0, 1) for g in (0, 1) for b in (0, 1))

#: The most views whose points are worked out at once.
MOST_VIEWS = 256


def nearest(df: DataFrame, palette=PALETTE) -> DataFrame:
    """Number of the palette's nearest colour, the first of equals; the palette is a literal in the expression."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(c) for c, v in zip("rgb", rgb)]) for i, rgb in enumerate(palette)])
    apart = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "gb"), (F.col("r") - p["r"]) * (F.col("r") - p["r"]))
    return df.select(*KEY, F.array_min(F.transform(entries, lambda p: F.struct(apart(p).alias("d"), p["i"].alias("i"))))["i"].alias("entry"))


def usage(df: DataFrame) -> DataFrame:
    """How often each entry is nearest, for each image, and its rank."""
    counted = nearest(df).groupBy("image_id", "entry").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "entry")))


def tiled(df: DataFrame, size: int = 4, halo: int = 1) -> DataFrame:
    """A row for each pixel and tile whose core or halo holds it: a pixel goes to at most nine tiles, without a join."""
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    spread = df.withColumn("tile_x", F.explode(near("x"))).withColumn("tile_y", F.explode(near("y")))
    most = (SIDE - 1) // size
    inside = F.col("tile_x").between(0, most) & F.col("tile_y").between(0, most)
    core = (F.floor(F.col("x") / size) == F.col("tile_x")) & (F.floor(F.col("y") / size) == F.col("tile_y"))
    return spread.filter(inside).withColumn("core", core)


def tile_sums(df: DataFrame) -> DataFrame:
    return tiled(df).groupBy("image_id", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.count_if("core").alias("n_core"), F.sum("r").alias("total"))


def channel_shift(df: DataFrame, by: int) -> DataFrame:
    """Red from `by` to the right, blue from `by` to the left; edges are continued."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    red, blue = F.coalesce(F.lead("r", by).over(row), F.last("r").over(whole)), F.coalesce(F.lag("b", by).over(row), F.first("b").over(whole))
    return df.select(*KEY, red.alias("r"), "g", blue.alias("b"), "a")


def rectangle(df: DataFrame, x: int, y: int, width: int, height: int, color: tuple[int, int, int], alpha: int) -> DataFrame:
    """A filled rectangle mixed in by its alpha, truncated; alpha is the greater of the two."""
    there = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    mixed = {c: F.when(there, F.floor((F.col(c) * (255 - alpha) + v * alpha) / 255).cast("int")).otherwise(F.col(c)) for c, v in zip("rgb", color)}
    return df.withColumns(mixed | {"a": F.when(there, F.greatest("a", F.lit(alpha))).otherwise(F.col("a"))})


def escapes(views: DataFrame, width: int = 24, height: int = 16, rounds: int = 40) -> DataFrame:
    """view_id, x, y and the rounds of z * z + c until a point leaves the circle of radius 2; all points of some views iterate at once.

    views: view_id, left, top, step, and cr, ci: the c of a Julia set, whose points begin at their place; null for the
    Mandelbrot set, where a point's place is its c.
    """
    k = np.arange(width * height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MOST_VIEWS):
                some = batch.slice(at, MOST_VIEWS)
                left, top, step, cr, ci = (some.column(c).to_numpy(zero_copy_only=False)[:, None] for c in range(1, 6))
                own, other = (np.array(some.column(c).is_null())[:, None] for c in (4, 5))
                u, v = left + k % width * step, top + k // width * step
                n = rounds_inside(np.where(own, 0.0, u), np.where(own, 0.0, v), np.where(own, u, cr), np.where(other, v, ci), rounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * k.size, pa.int32()), pa.array(n, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], ["view_id", "n"])

    # views are small rows, often of one small file, and the work of each is long
    dealt = views.repartition(4 * views.sparkSession.sparkContext.defaultParallelism, "view_id")
    numbers = [F.col(c).cast("double") for c in ("left", "top", "step", "cr", "ci")]
    found = dealt.select("view_id", *numbers).mapInArrow(run, f"view_id {dict(views.dtypes)['view_id']}, n array<int>")
    return found.select("view_id", F.posexplode("n").alias("i", "n")).select("view_id", (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "n")


def rounds_inside(r: np.ndarray, i: np.ndarray, c_r: np.ndarray, c_i: np.ndarray, rounds: int) -> np.ndarray:
    """The rounds of z * z + c from z = r + i until it is outside, for each point; those outside are left out of later rounds."""
    n = np.zeros(r.size, np.int32)
    r, i, c_r, c_i, still = r.ravel(), i.ravel(), c_r.ravel(), c_i.ravel(), np.arange(r.size)
    for _ in range(rounds):
        inside = r * r + i * i <= 4.0
        if not inside.all():
            r, i, c_r, c_i, still = (a[inside] for a in (r, i, c_r, c_i, still))
        n[still] += 1
        r, i = r * r - i * i + c_r, 2.0 * r * i + c_i
    return n


def views(s, d, julia: bool) -> DataFrame:
    """A view for each supplier, each a little to the right of the one before; Julia sets take their c from the key, too."""
    k = F.col("s_suppkey")
    c = [(k % 8 / 16.0 - 0.75), (k % 5 / 8.0 - 0.25)] if julia else [F.lit(None).cast("double")] * 2
    return table(s, d, "supplier").select(k.alias("view_id"), (k % 32 / 64.0 - 2.0).alias("left"), F.lit(-1.0).alias("top"), F.lit(0.125).alias("step"), c[0].alias("cr"), c[1].alias("ci"))


_ENTRIES = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE))
_NEAREST = PX + f", pa(i, pr, pg, pb) AS (VALUES {_ENTRIES}), ne AS (SELECT image_id, x, y, i AS entry FROM px, pa QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), i) = 1)"
_TILES = PX + """, ti AS (SELECT tx, ty FROM (SELECT unnest(range(2)) AS tx), (SELECT unnest(range(2)) AS ty))
SELECT image_id, tx AS tile_x, ty AS tile_y, count(*) AS n, count(*) FILTER (x // 4 = tx AND y // 4 = ty) AS n_core, CAST(sum(r) AS BIGINT) AS total
FROM px JOIN ti ON x BETWEEN tx * 4 - 1 AND tx * 4 + 4 AND y BETWEEN ty * 4 - 1 AND ty * 4 + 4 GROUP BY ALL"""
_SHIFT = PX + " SELECT p.image_id, p.x, p.y, q.r, p.g, s.b, p.a FROM px p JOIN px q ON q.image_id = p.image_id AND q.y = p.y AND q.x = least(p.x + 2, 7) JOIN px s ON s.image_id = p.image_id AND s.y = p.y AND s.x = greatest(p.x - 2, 0)"
_IN = "x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3"
_RECT = PX + " SELECT image_id, x, y, " + ", ".join(f"CASE WHEN {_IN} THEN CAST(({c} * 155 + {v} * 100) // 255 AS INTEGER) ELSE {c} END AS {c}" for c, v in zip("rgb", (250, 20, 90))) + f", CASE WHEN {_IN} THEN greatest(a, 100) ELSE a END AS a FROM px"
def _escapes(julia: bool) -> str:
    c = ("s_suppkey % 8 / CAST(16 AS DOUBLE) - 0.75", "s_suppkey % 5 / CAST(8 AS DOUBLE) - 0.25") if julia else ("u", "v")
    start = ("u", "v") if julia else ("CAST(0 AS DOUBLE)",) * 2
    return f"""WITH RECURSIVE g AS (SELECT s_suppkey, CAST(i % 24 AS INTEGER) AS x, CAST(i // 24 AS INTEGER) AS y, s_suppkey % 32 / CAST(64 AS DOUBLE) - 2 + i % 24 * CAST(0.125 AS DOUBLE) AS u, i // 24 * CAST(0.125 AS DOUBLE) - 1 AS v FROM supplier, unnest(range(384)) AS q(i)),
z AS (SELECT s_suppkey AS view_id, x, y, {c[0]} AS cr, {c[1]} AS ci, {start[0]} AS r, {start[1]} AS i, 0 AS n FROM g UNION ALL SELECT view_id, x, y, cr, ci, r * r - i * i + cr, CAST(2 AS DOUBLE) * r * i + ci, n + 1 FROM z WHERE n < 40 AND r * r + i * i <= 4)
SELECT view_id, x, y, max(n) AS n FROM z GROUP BY view_id, x, y"""


OPS = {
    "nearest_palette": (lambda s, d: nearest(pixels(s, d)), _NEAREST + " SELECT * FROM ne"),
    "palette_usage": (lambda s, d: usage(pixels(s, d)), _NEAREST + ", us AS (SELECT image_id, entry, count(*) AS n FROM ne GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, entry) AS place FROM us"),
    "tiles_with_halo": (lambda s, d: tile_sums(pixels(s, d)), _TILES),
    "channel_shift": (lambda s, d: channel_shift(pixels(s, d), 2), _SHIFT),
    "draw_rectangle": (lambda s, d: rectangle(pixels(s, d), 2, 1, 4, 3, (250, 20, 90), 100), _RECT),
    "mandelbrot": (lambda s, d: escapes(views(s, d, False)), _escapes(False)),
    "julia": (lambda s, d: escapes(views(s, d, True)), _escapes(True)),
}
