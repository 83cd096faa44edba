"""Palette files that come back, and damaged ones; diffusion both ways against a plain loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import palette_files as p


def read(spark, files, kind, of):
    rows = spark.createDataFrame(list(enumerate(files)), f"k int, f {kind}").select("k", of(F.col("f")).alias("c")).orderBy("k").collect()
    return [None if r.c is None else [tuple(x) for x in r.c] for r in rows]


def test_gpl(spark):
    good = "GIMP Palette\r\nName: x\r\nColumns: 3\r\n# remark\r\n  1   2 3\tone\r\n255 0 999\r\nno colour\r\n4 5\r\n"
    assert read(spark, [good, "GIMP Palette", "JASC-PAL\n1 2 3", None, ""], "string", p.from_gpl) == [[(1, 2, 3), (255, 0, 255)], [], None, None, None]


def test_aco(spark):
    entry = lambda space, *v: b"".join(x.to_bytes(2, "big") for x in (space, *v))
    two = b"\0\1\0\2" + entry(0, 257, 65535, 300, 0) + entry(0, 0, 1, 2, 3)
    other = b"\0\1\0\2" + entry(7, 1, 1, 1, 1) + entry(0, 514, 0, 0, 0)
    assert read(spark, [bytearray(f) if f is not None else None for f in (two, two[:-1], other, b"\0\1\0\0", b"\0\2\0\1" + entry(0, 1, 2, 3, 4), b"\0", None)], "binary", p.from_aco) == [
        [(1, 255, 1), (0, 0, 0)], [(1, 255, 1)], [(2, 0, 0)], [], None, None, None]


def test_files_come_back(spark):
    colours = [(0, 0, 0), (255, 1, 128), (7, 77, 177)]
    row = spark.createDataFrame([(colours,), ([],)], "c array<struct<r: int, g: int, b: int>>")
    got = row.select(p.from_gpl(p.gpl(F.col("c"))).alias("g"), p.from_aco(p.aco(F.col("c"))).alias("a")).collect()
    assert [[tuple(x) for x in v] for r in got for v in r] == [colours, colours, [], []]


def test_diffusion_both_ways():
    v = np.random.default_rng(1).integers(0, 256, (2, 6, 7))
    got = p.both_ways(v)
    for image, out in zip(v, got):
        rest = image.astype(np.float32)
        for y in range(6):
            step = 1 if y % 2 == 0 else -1
            for x in range(7)[::step]:
                chosen = 255 if rest[y, x] >= 128 else 0
                assert out[y, x] == chosen
                error = rest[y, x] - np.float32(chosen)
                for dx, dy, share in ((step, 0, 7), (-step, 1, 3), (0, 1, 5), (step, 1, 1)):
                    if 0 <= x + dx < 7 and y + dy < 6:
                        rest[y + dy, x + dx] += error * np.float32(share / 16)
