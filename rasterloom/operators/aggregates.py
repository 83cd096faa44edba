"""Histograms, statistics and thresholds: group-bys and windows over the pixel relation; votes, image by image.

Groups are (image, channel, bin) and the like, combined before the shuffle; windows run over at most 256 bins of
one image, never over its pixels.  Votes at 180 angles are far more than pixels, so they are counted within an image.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..oracle import LUMA, PX, byte as sql_byte, f, pick
from ..sources.tables import byte, f32, gray, images, luma, pixels, stacks


def long(df: DataFrame) -> DataFrame:
    """image_id, channel, v of all channels and of the luma."""
    values = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"], F.struct(F.lit("gray").alias("channel"), byte(luma()).alias("v")))
    return df.select("image_id", F.inline(values))


def histogram(df: DataFrame) -> DataFrame:
    """image_id, channel, bin, n of the bins that occur."""
    return long(df).groupBy("image_id", "channel", F.col("v").alias("bin")).agg(F.count("*").alias("n"))


def dense(found: DataFrame) -> DataFrame:
    """All 256 bins, empty ones with 0."""
    every = found.select("image_id", "channel").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return every.join(found, ["image_id", "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def statistics(df: DataFrame) -> DataFrame:
    """Mean and population variance of each channel; entropy in bits of the luma."""
    mean = lambda c: F.avg(c).cast("float")
    moments = df.groupBy("image_id").agg(
        *[F.round(mean(c), 3).alias(f"mean_{c}") for c in "rgb"],
        *[F.round(F.avg(F.col(c) * F.col(c)) - mean(c) * mean(c), 1).alias(f"var_{c}") for c in "rgb"])
    counted = df.groupBy("image_id", byte(luma()).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))
    entropy = counted.withColumn("p", share).groupBy("image_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))
    return moments.join(entropy, "image_id")


def equalize(df: DataFrame) -> DataFrame:
    """Each channel by its cumulative histogram."""
    bins = Window.partitionBy("image_id", "channel").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id", "channel")
    cdf = histogram(df).withColumn("cdf", F.sum("n").over(bins)).withColumn("least", F.min("cdf").over(whole)).withColumn("all", F.sum("n").over(whole))
    to = F.when(F.col("all") == F.col("least"), F.col("bin")).otherwise(F.round((f32(255) * f32(F.col("cdf") - F.col("least")) / f32(F.col("all") - F.col("least"))).cast("float")).cast("int"))
    tables = cdf.filter("channel <> 'gray'").groupBy("image_id").pivot("channel", ["r", "g", "b"]).agg(F.map_from_entries(F.collect_list(F.struct("bin", to.alias("to")))))
    tables = tables.toDF("image_id", "to_r", "to_g", "to_b")
    return df.join(tables, "image_id").select("image_id", "x", "y", *[F.element_at(f"to_{c}", F.col(c)).alias(c) for c in "rgb"])


def otsu(df: DataFrame) -> DataFrame:
    """image_id, level: the middle of the levels of greatest variance between two classes; 128 where there's one value."""
    counted = df.groupBy("image_id", F.col("v").alias("bin")).agg(F.count("*").alias("n"))
    filled = counted.select("image_id").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin")).join(counted, ["image_id", "bin"], "left").fillna(0, ["n"])
    upto = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    sums = filled.select("*", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"))
    # the variance between classes times whole numbers: (s w0 - s0 w)^2 / (w0 (w - w0))
    gap = (F.col("s") * F.col("w0") - F.col("s0") * F.col("w")).cast("double")
    between = sums.withColumn("between", F.when((F.col("w0") > 0) & (F.col("w0") < F.col("w")), gap * gap / (F.col("w0") * (F.col("w") - F.col("w0")))))
    best = between.withColumn("most", F.max("between").over(whole)).filter("between = most")
    found = best.groupBy("image_id").agg(F.floor((F.min("bin") + F.max("bin")) / 2).cast("int").alias("level"))
    return counted.select("image_id").distinct().join(found, "image_id", "left").fillna(128, ["level"])


def ssim(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of images at one place (image_id, x, y, v, and w of the other): similarity over one window of the whole image."""
    both = a.join(b.withColumnRenamed("v", "w"), ["image_id", "x", "y"])
    c1, c2 = 6.5025, 58.5225
    m = both.groupBy("image_id").agg(F.avg("v").alias("mv"), F.avg("w").alias("mw"), F.var_samp("v").alias("vv"), F.var_samp("w").alias("vw"), F.covar_samp("v", "w").alias("cov"))
    return m.select("image_id", F.round((2 * F.col("mv") * F.col("mw") + c1) * (2 * F.col("cov") + c2) / ((F.col("mv") ** 2 + F.col("mw") ** 2 + c1) * (F.col("vv") + F.col("vw") + c2)), 4).alias("ssim"))


def match_histogram(df: DataFrame) -> DataFrame:
    """Each image's samples to those of the next image whose share of the cumulative histogram is nearest, the lowest of equals."""
    counted = df.groupBy("image_id", F.col("v").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = counted.select("image_id", "bin", F.sum("n").over(upto).alias("cdf"))
    every = df.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("to"))
    wide = every.join(cdf.withColumnRenamed("bin", "to"), ["image_id", "to"], "left")
    full = wide.select((F.col("image_id") - 1).alias("image_id"), "to", F.coalesce(F.last("cdf", ignorenulls=True).over(Window.partitionBy("image_id").orderBy("to").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("want"))
    levels = full.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("to", "want"))).alias("levels"))  # 256 entries
    gaps = F.transform("levels", lambda x: F.struct(F.abs(x["want"] - F.col("cdf")).alias("gap"), x["to"].alias("to")))
    table = cdf.join(levels, "image_id").select("image_id", F.col("bin").alias("v"), F.array_min(gaps)["to"].alias("to"))
    return df.join(table, ["image_id", "v"]).select("image_id", "x", "y", F.col("to").alias("v"))


def blocks(df: DataFrame, n: int) -> DataFrame:
    """Each block's whole mean in all of its pixels."""
    key = ["image_id", F.floor(F.col("x") / n).alias("bx"), F.floor(F.col("y") / n).alias("by")]
    means = df.groupBy(*key).agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in "rgba"])
    return df.select("image_id", "x", "y", *key[1:]).join(means, ["image_id", "bx", "by"]).drop("bx", "by")


def peaks(shown: np.ndarray, least: int, angles: int) -> tuple[np.ndarray, ...]:
    """image, theta, rho, votes and place of the lines of a stack (image, y, x), by image and place."""
    n, h, w = shown.shape
    image, y, x = np.nonzero(shown)
    low, width = -w, 2 * w + h + 2  # rho is between 1 - w and w + h - 2; an empty column on either side
    votes = np.zeros((n, angles, width), np.int32)
    for t in range(angles):
        at = x * round(cos(t * pi / angles), 9) + y * round(sin(t * pi / angles), 9)
        whole = np.trunc(at)
        rho = (whole + np.sign(at) * (np.abs(at - whole) >= 0.5)).astype(np.int64)
        votes[:, t] = np.bincount(image * width + rho - low, minlength=n * width).reshape(n, width)
    most = np.maximum(np.maximum(np.roll(votes, 1, 1), np.roll(votes, -1, 1)), votes)
    most[:, :, 1:-1] = np.maximum(np.maximum(most[:, :, :-2], most[:, :, 2:]), most[:, :, 1:-1])
    image, theta, rho = np.nonzero((votes >= max(least, 1)) & (votes == most))
    found = votes[image, theta, rho]
    order = np.lexsort((rho, theta, -found, image))
    image, theta, rho, found = image[order], theta[order], rho[order] + low, found[order]
    return image, theta, rho, found, np.arange(len(image)) - np.searchsorted(image, image) + 1


def hough(df: DataFrame, least: int, angles: int = 180) -> DataFrame:
    """Lines by votes: samples over 127 vote at each angle for a distance; peaks of the 3 x 3 neighbourhood stay.

    df: images as rows.  place counts an image's lines from the strongest on.  Votes are counted where an image lies, so
    nothing is shuffled; samples beyond width times height don't count, and missing ones don't vote.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, h, some in stacks(parts):
            shown = np.stack([np.frombuffer(v, np.uint8) for v in some["v"]]).reshape(len(some), h, w)
            image, *line = peaks(shown, least, angles)
            yield pd.DataFrame({"image_id": some["image_id"].to_numpy()[image]} | dict(zip(("theta", "rho", "votes", "place"), line)))

    n = (F.col("width") * F.col("height")).cast("int")
    over = F.array_join(F.transform(F.slice("v", 1, n), lambda v: F.when(v > 127, "01").otherwise("00")), "")
    images = df.filter("width > 0 AND height > 0 AND size(v) > 0").select("image_id", "width", "height", F.unhex(F.rpad(over, n * 2, "0")).alias("v"))
    return images.mapInPandas(run, f"image_id {dict(df.dtypes)['image_id']}, theta int, rho int, votes long, place int")


_LONG = PX + f""", l AS (SELECT image_id, unnest(['r', 'g', 'b', 'gray']) AS channel, unnest([r, g, b, {sql_byte(LUMA)}]) AS v FROM px),
hi AS (SELECT image_id, channel, v AS bin, count(*) AS n FROM l GROUP BY ALL)"""
_MEAN = lambda c: f"CAST(avg({c}) AS FLOAT)"
_STATS = PX + f""", h AS (SELECT image_id, {sql_byte(LUMA)} AS bin, count(*) AS n FROM px GROUP BY ALL),
p AS (SELECT image_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY image_id) AS p FROM h), t AS (SELECT image_id, round(-sum(p * log2(p)), 4) AS entropy FROM p GROUP BY image_id),
m AS (SELECT image_id, {', '.join(f'round({_MEAN(c)}, 3) AS mean_{c}, round(avg({c} * {c}) - {_MEAN(c)} * {_MEAN(c)}, 1) AS var_{c}' for c in 'rgb')} FROM px GROUP BY image_id)
SELECT * FROM m JOIN t USING (image_id)"""
_EQUALIZE = _LONG + f""", c AS (SELECT *, sum(n) OVER (PARTITION BY image_id, channel ORDER BY bin) AS cdf FROM hi),
k AS (SELECT *, min(cdf) OVER (PARTITION BY image_id, channel) AS least, max(cdf) OVER (PARTITION BY image_id, channel) AS total FROM c),
t AS (SELECT image_id, channel, bin, CASE WHEN total = least THEN bin ELSE CAST(round({f(255)} * {f('cdf - least')} / {f('total - least')}) AS INTEGER) END AS v FROM k)
SELECT px.image_id, px.x, px.y, tr.v AS r, tg.v AS g, tb.v AS b FROM px JOIN t tr ON tr.image_id = px.image_id AND tr.channel = 'r' AND tr.bin = px.r
JOIN t tg ON tg.image_id = px.image_id AND tg.channel = 'g' AND tg.bin = px.g JOIN t tb ON tb.image_id = px.image_id AND tb.channel = 'b' AND tb.bin = px.b"""
_OTSU = PX + """, h AS (SELECT image_id, v AS bin, count(*) AS n FROM gr GROUP BY ALL), z AS (SELECT DISTINCT image_id FROM gr), b AS (SELECT image_id, unnest(range(256)) AS t FROM z),
w AS (SELECT b.image_id, t, sum(n) FILTER (bin <= t) AS w0, sum(n * bin) FILTER (bin <= t) AS s0, sum(n) AS w, sum(n * bin) AS s FROM b JOIN h USING (image_id) GROUP BY b.image_id, t),
v AS (SELECT image_id, t, CAST(s * w0 - s0 * w AS DOUBLE) * CAST(s * w0 - s0 * w AS DOUBLE) / (w0 * (w - w0)) AS e FROM w WHERE w0 > 0 AND w0 < w),
m AS (SELECT image_id, (min(t) + max(t)) // 2 AS level FROM v JOIN (SELECT image_id, max(e) AS top FROM v GROUP BY image_id) USING (image_id) WHERE e = top GROUP BY image_id)
SELECT image_id, CAST(coalesce(level, 128) AS INTEGER) AS level FROM z LEFT JOIN m USING (image_id)"""
_SSIM = PX + """, m AS (SELECT p.image_id, avg(p.v) AS mv, avg(q.v) AS mw, var_samp(p.v) AS vv, var_samp(q.v) AS vw, covar_samp(p.v, q.v) AS c FROM gr p JOIN gr q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y GROUP BY p.image_id)
SELECT image_id, round((2 * mv * mw + 6.5025) * (2 * c + 58.5225) / ((mv * mv + mw * mw + 6.5025) * (vv + vw + 58.5225)), 4) AS ssim FROM m"""
_MATCH = PX + """, b AS (SELECT DISTINCT image_id FROM gr), s AS (SELECT g.image_id, g.v, count(*) AS cdf FROM (SELECT DISTINCT image_id, v FROM gr) g JOIN gr o ON o.image_id = g.image_id AND o.v <= g.v GROUP BY ALL),
w AS (SELECT t.image_id - 1 AS image_id, t.t, (SELECT count(*) FROM gr o WHERE o.image_id = t.image_id AND o.v <= t.t) AS want FROM (SELECT image_id, unnest(range(256)) AS t FROM b) t),
m AS (SELECT s.image_id, s.v, w.t FROM s JOIN w USING (image_id) QUALIFY row_number() OVER (PARTITION BY s.image_id, s.v ORDER BY abs(want - cdf), t) = 1)
SELECT gr.image_id, x, y, CAST(t AS INTEGER) AS v FROM gr JOIN m USING (image_id, v)"""
_BLOCKS = PX + """, m AS (SELECT image_id, x // 3 AS mx, y // 3 AS my, """ + ", ".join(f"CAST(sum({c}) // count(*) AS INTEGER) AS {c}" for c in "rgba") + """ FROM px GROUP BY ALL)
SELECT px.image_id, x, y, m.r, m.g, m.b, m.a FROM px JOIN m ON m.image_id = px.image_id AND mx = x // 3 AND my = y // 3"""
_HOUGH = PX + """, t AS (SELECT unnest(range(180)) AS theta), v AS (SELECT image_id, theta, CAST(round(x * round(cos(theta * pi() / 180), 9) + y * round(sin(theta * pi() / 180), 9)) AS INTEGER) AS rho, count(*) AS votes FROM gr, t WHERE gr.v > 127 GROUP BY ALL)
SELECT a.image_id, CAST(a.theta AS INTEGER) AS theta, a.rho, a.votes FROM v a WHERE a.votes >= 5 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.image_id = a.image_id AND b.votes > a.votes AND abs(b.rho - a.rho) <= 1 AND (b.theta - a.theta + 180) % 180 IN (0, 1, 179))"""

OPS = {
    "histogram": (lambda s, d: histogram(pixels(s, d)), _LONG + " SELECT * FROM hi"),
    "dense_histogram": (
        lambda s, d: dense(histogram(pixels(s, d))).groupBy("channel", "bin").agg(F.sum("n").alias("n")),
        _LONG + " SELECT channel, b.bin, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT unnest(['r', 'g', 'b', 'gray']) AS channel) CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) b LEFT JOIN hi USING (channel, bin) GROUP BY channel, b.bin"),
    "statistics": (lambda s, d: statistics(pixels(s, d)), _STATS),
    "equalize": (lambda s, d: equalize(pixels(s, d)), _EQUALIZE),
    "otsu_threshold": (lambda s, d: otsu(gray(s, d)), _OTSU),
    "ssim": (lambda s, d: ssim(gray(s, d), gray(s, d).withColumn("image_id", F.col("image_id") - 1)), _SSIM),
    "match_histogram": (lambda s, d: match_histogram(gray(s, d)), _MATCH),
    "pixelate": (lambda s, d: blocks(pixels(s, d), 3), _BLOCKS),
    "hough_lines": (lambda s, d: hough(images(s, d), 5).drop("place"), _HOUGH),
}
