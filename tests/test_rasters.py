"""Image files made by hand, byte by byte."""

import struct

from pyspark.sql import functions as F

from rasterloom.sources import rasters


def read(spark, files, decode):
    rows = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "i int, d binary").select("i", decode(F.col("d")).alias("im")).collect()
    return [None if r.im is None else (r.im.width, r.im.height, r.im.channels, r.im.v) for r in sorted(rows)]


def test_netpbm(spark):
    files = [
        b"P1\n# bits\n3 2\n1 0 1\n010\n", b"P2 2 2 4\n0 1 # one\n2 4", b"P3\n1 2\n255\n1 2 3 4 5 6\n", b"P4\n10 2\n" + bytes([0b10100000, 0b01000000, 0xFF, 0b10000000]),
        b"P5\n# " + b"a long remark " * 20 + b"\n2 1\n255\n" + bytes([7, 255]), b"P5 2 1 65535\n" + bytes([0xFF, 0xFF, 0x80, 0x00]),
        b"P6 2 1 15\n" + bytes([0, 15, 3, 1, 2, 5]), b"P6\n2 1\n255\n" + bytes([9, 8]), b"P7\n1 1\n255\n1", b"", b"P5 2 0 255\n",
    ]
    assert read(spark, files, rasters.netpbm) == [
        (3, 2, 1, [0, 255, 0, 255, 0, 255]), (2, 2, 1, [0, 63, 127, 255]), (1, 2, 3, [1, 2, 3, 4, 5, 6]),
        (10, 2, 1, [0, 255, 0] + [255] * 6 + [0] + [0] * 9 + [255]), (2, 1, 1, [7, 255]), (2, 1, 1, [255, 127]),
        (2, 1, 3, [0, 255, 51, 17, 34, 85]), (2, 1, 3, [9, 8, 0, 0, 0, 0]), None, None, None,
    ]


def head(size, width, height, depth, packing=0):
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", size, 0, 54, 40, width, height, 1, depth, packing, 0, 0, 0, 0, 0)


def test_bmp(spark):
    up = head(70, 2, 2, 24) + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    down = head(62, 1, -2, 32) + bytes([1, 2, 3, 4, 5, 6, 7, 8])
    assert read(spark, [up, down, up[:-8], head(54, 1, 1, 8) + b"\0\0\0\0", b"BM"], rasters.bmp_image) == [
        (2, 2, 3, [9, 8, 7, 12, 11, 10, 3, 2, 1, 6, 5, 4]), (1, 2, 4, [3, 2, 1, 4, 7, 6, 5, 8]), (2, 2, 3, [0] * 6 + [3, 2, 1, 6, 5, 4]), None, None,
    ]


def test_tga(spark):
    def file(kind, width, height, depth, body, flags=0x20, colours=b"", entry=0):
        return struct.pack("<BBBHHBHHHHBB", 2, int(bool(colours)), kind, 0, len(colours) * 8 // entry if entry else 0, entry, 0, 0, width, height, depth, flags) + b"id" + colours + body

    files = [
        file(2, 1, 2, 24, bytes([1, 2, 3, 4, 5, 6])), file(2, 1, 2, 24, bytes([1, 2, 3, 4, 5, 6]), 0),
        file(10, 3, 2, 24, bytes([0x83, 1, 2, 3, 0x01, 4, 5, 6, 7, 8, 9])), file(1, 2, 1, 8, bytes([1, 9]), colours=bytes([1, 2, 3, 4, 5, 6]), entry=24),
        file(9, 4, 1, 8, bytes([0x81, 0, 0x01, 1, 0]), colours=bytes([1, 2, 3, 9, 4, 5, 6, 8]), entry=32), file(3, 1, 1, 8, b"\1"), b"short",
        file(2, 2, 1, 24, bytes([1, 2, 3])),
    ]
    assert read(spark, files, rasters.tga_image) == [
        (1, 2, 3, [3, 2, 1, 6, 5, 4]), (1, 2, 3, [6, 5, 4, 3, 2, 1]), (3, 2, 3, [3, 2, 1] * 4 + [6, 5, 4, 9, 8, 7]), (2, 1, 3, [6, 5, 4, 0, 0, 0]),
        (4, 1, 4, [3, 2, 1, 9] * 2 + [6, 5, 4, 8, 3, 2, 1, 9]), None, None, (2, 1, 3, [3, 2, 1, 0, 0, 0]),
    ]
