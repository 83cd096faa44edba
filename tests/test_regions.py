"""Rectangles, names of modes and blank images on rows made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import regions


def test_rectangles(spark):
    rows = [((0, 0, 4, 3), (2, 1, 9, 9)), ((0, 0, 0, 3), (2, 1, 9, 9)), ((5, 5, 2, 2), (0, 0, 5, 5)), ((-3, -3, 2, 2), (-2, -2, 1, -4))]
    df = spark.createDataFrame(rows, "a struct<x: long, y: long, w: long, h: long>, b struct<x: long, y: long, w: long, h: long>")
    a, b = F.col("a"), F.col("b")
    got = df.select(regions.intersected(a, b).alias("i"), regions.united(a, b).alias("u"), regions.area(a).alias("n"), regions.contains(b, a["x"], a["y"]).alias("in"), regions.expanded(a, 1, 6, 6).alias("e")).collect()
    assert [tuple(r.i) for r in got] == [(2, 1, 2, 2), (2, 1, 0, 2), (5, 5, 0, 0), (-2, -2, 1, 0)]
    assert [tuple(r.u) for r in got] == [(0, 0, 11, 10), (2, 1, 9, 9), (0, 0, 7, 7), (-3, -3, 2, 2)]
    assert [r.n for r in got] == [12, 0, 4, 4] and [r["in"] for r in got] == [False, False, False, False]
    assert [tuple(r.e) for r in got] == [(0, 0, 5, 4), (0, 0, 1, 4), (4, 4, 2, 2), (0, 0, 0, 0)]


def test_mode_names(spark):
    names = ["Multiply", "SOFT_LIGHT", "Soft Light", "color-dodge", "ColorBurn", "hue", "what", None, ""]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(regions.mode_name(F.col("n"))).collect()]
    assert got == ["multiply", "soft_light", "soft_light", "color_dodge", "color_burn", "hue", "normal", "normal", "normal"]


def test_blank_images_and_children(spark):
    sizes = spark.createDataFrame([(1, 2, 1), (2, 0, 5)], "image_id long, width int, height int")
    assert sorted(map(tuple, regions.blank(sizes, 3).collect())) == [(1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0)]
    assert regions.blank(sizes, 1).columns == ["image_id", "x", "y", "v"] and regions.blank(sizes, 2).columns[-1] == "a"
    old = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 9, 0)], "id long, parent long, z int")
    new = spark.createDataFrame([(8, 0), (7, 0), (6, 9)], "id long, parent long")
    got = sorted((r.parent, r.z, r.id) for r in regions.child_inserted(old, 1, new).collect())
    assert got == [(0, 0, 1), (0, 1, 7), (0, 2, 8), (0, 3, 2), (9, 0, 3), (9, 1, 6)]
