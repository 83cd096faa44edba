"""Reading tables, and images as rows.

An image is a set of rows (image_id, x, y, r, g, b, a) with integer channels of 0 to 255.  The embeddings table
stands for a store of 8 x 8 images: its 64 numbers are scaled to bytes, and the channels are shifted copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
KEY = ["image_id", "x", "y"]
#: The most images, and the most samples of a channel, that are stacked; an image with more is a stack by itself.
MOST_STACKED, MOST_SAMPLES = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(embedding: Column) -> Column:
    """The 64 bytes of an image."""
    return F.transform(embedding, lambda e: F.least(F.greatest(F.floor(e.cast("double") * 255 + 128), F.lit(0)), F.lit(255)).cast("int"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each image: image_id, width, height, v (its bytes, row by row)."""
    side = F.lit(SIDE)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), side.alias("width"), side.alias("height"), samples(F.col("embedding")).alias("v"))


def stacks(parts: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """Width, height and rows of images of one size, so few that what is worked out of them stays small, however long parts are."""
    for part in parts:
        for (w, h), some in part.groupby(["width", "height"], sort=False):
            n = max(1, min(MOST_STACKED, MOST_SAMPLES // max(1, w * h)))
            for at in range(0, len(some), n):
                yield w, h, some.iloc[at : at + n]


#: Width, height and source images of a quilt.
QUILT = (32, 24, 12)


def quilts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images of 32 x 24, a row for each channel: image_id, channel, width, height, v.

    The samples of twelve images of the table, one after the other, are the red ones (0 where there are fewer); green and
    blue are red moved on by a third and two thirds.
    """
    width, height, n = QUILT
    size, third = width * height, width * height // 3
    twelve = images(spark, sf_dir).groupBy(F.floor(F.col("image_id") / n).alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("image_id", "v"))).alias("l"))
    flat = F.slice(F.concat(F.flatten(F.transform("l", lambda x: x["v"])), F.array_repeat(F.lit(0), size)), 1, size)
    turn = lambda k: F.concat(F.slice("v", k + 1, size), F.slice("v", 1, k))
    planes = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), turn(k * third).alias("v")) for k, c in enumerate("rgb")]))
    return twelve.select("image_id", flat.alias("v")).select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), planes.alias("p")).select(
        "image_id", "p.channel", "width", "height", "p.v")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pixel: image_id, x, y, r, g, b, a; alpha varies over the image."""
    return images(spark, sf_dir).select("image_id", "v", F.posexplode("v").alias("i", "r")).select(
        "image_id", (F.col("i") % SIDE).alias("x"), F.expr(f"cast(i div {SIDE} as int)").alias("y"), "r",
        F.get("v", (F.col("i") + 21) % 64).alias("g"), F.get("v", (F.col("i") + 42) % 64).alias("b"), (F.col("i") * 37 % 256).alias("a"),
    )


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pixel of the one-channel image: image_id, x, y, v."""
    return images(spark, sf_dir).select("image_id", F.posexplode("v").alias("i", "v")).select(
        "image_id", (F.col("i") % SIDE).alias("x"), F.expr(f"cast(i div {SIDE} as int)").alias("y"), "v")


def f32(value) -> Column:
    """A number or column in single precision, as channel arithmetic is done."""
    return (F.lit(float(value)) if isinstance(value, (int, float)) else value).cast("float")


def byte(value: Column) -> Column:
    """Clamped to 0..255 and truncated."""
    return F.least(F.greatest(value, f32(0)), f32(255)).cast("int")


def luma(r="r", g="g", b="b") -> Column:
    return f32(0.299) * f32(F.col(r)) + f32(0.587) * f32(F.col(g)) + f32(0.114) * f32(F.col(b))
