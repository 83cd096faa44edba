"""Colour image files as Columns: Netpbm (P1 to P6), BMP and TGA, read and written with built-in functions.

A file is a row with its bytes (as spark.read.format("binaryFile") gives them); an image is a struct of width,
height, channels and v (samples row by row from the top, channels side by side).  What can't be read is null; samples
that a cut file lacks are 0.  Bytes are split once, so the work is linear in the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..oracle import pick
from .codecs import hex_bytes, little
from .tables import images

#: The largest side of an image, and the most samples for each byte of its file: with more, so much is missing that it isn't read.
MOST_SIDE, MOST_A_BYTE = 32768, 64
IMAGE = "struct<width:int,height:int,channels:int,v:array<int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, whatever the optimizer puts in its place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bytes_of(data: Column) -> Column:
    """The bytes as an array of numbers."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


def at(b: Column, i) -> Column:
    return F.coalesce(F.get(b, i if isinstance(i, Column) else F.lit(i)), F.lit(0))


def number(b: Column, i: int, size: int) -> Column:
    """A little-endian number without sign."""
    return sum((at(b, i + k) * (1 << 8 * k) for k in range(1, size)), at(b, i))


def count(n: Column, of: Callable[[Column], Column]) -> Column:
    """of(0), of(1), ... of(n - 1)."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast("array<int>"))


def image(width: Column, height: Column, channels: Column, v: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), channels.cast("int").alias("channels"), v.alias("v"))


def netpbm(data: Column) -> Column:
    """A bit map, gray map or pixel map, plain or binary; samples are scaled to 255 by their maximum, of up to two bytes."""
    text = F.decode(data, "ISO-8859-1")
    gap = r"\s++(?:#[^\n]*+\n\s*+)*+"
    head = rf"(?s)^P([1-6]){gap}(\d+){gap}(\d+)"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    kind = part(head, 1)
    bits = kind.isin("1", "4")
    full = F.when(bits, part(head + r"\s", 0)).otherwise(part(head + rf"{gap}(\d+)\s", 0))
    most = F.when(bits, 1).otherwise(part(head + rf"{gap}(\d+)\s", 4).try_cast("int"))
    width, height = part(head, 2).try_cast("int"), part(head, 3).try_cast("int")
    channels = F.when(kind.isin("3", "6"), 3).otherwise(1)
    body = F.regexp_replace(F.substr(text, F.length(full) + 1), r"#[^\n]*", "")
    digits = F.regexp_extract_all(body, F.when(kind == "1", "([01])").otherwise(r"(\d+)"), F.lit(1))
    scaled = lambda s: F.floor(s * 255 / most).cast("int")

    def samples(parts: Column, own: Column, n: Column) -> Column:
        start = F.length(full)
        row = F.ceil(width / 8).cast("int")
        bit = lambda i: F.get(F.lit([128, 64, 32, 16, 8, 4, 2, 1]), i % width % 8)
        packed = lambda i: F.when(at(own, start + F.floor(i / width).cast("int") * row + F.floor(i % width / 8).cast("int")).bitwiseAND(bit(i)) != 0, 0).otherwise(255)
        wide = most > 255
        binary = lambda i: F.when(wide, at(own, start + i * 2) * 256 + at(own, start + i * 2 + 1)).otherwise(at(own, start + i))
        return (
            F.when(kind == "1", count(n, lambda i: F.when(F.get(parts, i) == "1", 0).otherwise(255)))
            .when(kind == "4", count(n, packed))
            .when(kind.isin("2", "3"), count(n, lambda i: scaled(F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0)))))
            .otherwise(count(n, lambda i: scaled(binary(i))))
        )

    # checked first, in longs: a header may claim any size
    claimed = width.cast("long") * height.cast("long") * channels
    good = (F.length(full) > 0) & most.between(1, 65535) & (width > 0) & (height > 0) & (width <= MOST_SIDE) & (height <= MOST_SIDE) & (claimed <= F.length(data).cast("long") * MOST_A_BYTE)
    v = let(digits, lambda parts: let(bytes_of(data), lambda own: F.when(good, samples(parts, own, (width * height * channels)))))
    return F.when(good, image(width, height, channels, v))


def from_rows(b: Column, start: Column, width: Column, height: Column, channels: Column, stride: Column, top_down: Column) -> Column:
    """Samples of rows of blue, green, red (and alpha)."""
    def sample(i: Column) -> Column:
        x, c = F.floor(i / channels).cast("int") % width, i % channels
        y = F.floor(i / (channels * width)).cast("int")
        row = F.when(top_down, y).otherwise(height - 1 - y)
        return at(b, start + row * stride + x * channels + F.when(c < 3, 2 - c).otherwise(3))

    return count(width * height * channels, sample)


def bmp_image(data: Column) -> Column:
    """An uncompressed file of 24 or 32 bits; rows from the bottom up, or from the top if the height is below 0."""
    def read(b: Column) -> Column:
        width, depth, packing = number(b, 18, 3), number(b, 28, 2), number(b, 30, 4)
        signed = number(b, 22, 3) + at(b, 25).cast("long") * (1 << 24)
        down = signed >= 1 << 31
        height = F.when(down, F.lit(1 << 32) - signed).otherwise(signed).cast("int")
        channels = (depth / 8).cast("int")
        stride = F.floor((width * channels + 3) / 4).cast("int") * 4
        good = (F.size(b) >= 54) & (at(b, 0) == 66) & (at(b, 1) == 77) & depth.isin(24, 32) & packing.isin(0, 3) & (width > 0) & (height > 0)
        good &= (number(b, 10, 4) < F.size(b)) & (number(b, 14, 4) >= 40)
        return F.when(good, image(width, height, channels, from_rows(b, number(b, 10, 4), width, height, channels, stride, down)))

    return let(bytes_of(data), read)


def tga_image(data: Column) -> Column:
    """True colour of 24 or 32 bits, or 8 bits with a colour map; plain or in runs; from the bottom up or the top down."""
    def unpacked(b: Column, start: Column, n: Column, size: Column) -> Column:
        """Where each of the n pixels of packed runs begins."""
        begin = F.struct(start.alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<at:int,n:int,step:int>>").alias("runs"))

        def packet(s: Column, _: Column) -> Column:
            head = at(b, s["at"])
            long, run = head % 128 + 1, head >= 128
            taken = F.least(long, n - s["n"])
            body = F.when(run, size).otherwise(long * size)
            more = F.struct((s["at"] + 1).alias("at"), taken.alias("n"), F.when(run, 0).otherwise(size).alias("step"))
            return F.when((s["n"] >= n) | (s["at"] >= F.size(b)), s).otherwise(
                F.struct((s["at"] + 1 + body).alias("at"), (s["n"] + taken).alias("n"), F.concat(s["runs"], F.array(more)).alias("runs")))

        runs = F.aggregate(F.sequence(F.lit(1), n), begin, packet)["runs"]
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda k: r["at"] + r["step"] * k)))

    def header(b: Column) -> Column:
        """What is read from the header, once for a file."""
        kind, depth = at(b, 2), at(b, 16)
        mapped, entry = kind.isin(1, 9), (at(b, 7) / 8).cast("int")
        map_at, map_size = at(b, 0) + 18, F.when(at(b, 1) == 1, number(b, 5, 2)).otherwise(0)
        channels = F.when(mapped, entry).otherwise((depth / 8).cast("int"))
        width, height = number(b, 12, 2), number(b, 14, 2)
        good = (F.size(b) >= 18) & (width > 0) & (height > 0) & F.when(mapped, (depth == 8) & (at(b, 1) == 1) & entry.isin(3, 4)).otherwise(kind.isin(2, 10) & depth.isin(24, 32))
        return F.struct(
            kind.alias("kind"), mapped.alias("mapped"), entry.alias("entry"), map_at.alias("map_at"), map_size.alias("map_size"), channels.alias("channels"),
            width.alias("width"), height.alias("height"), (at(b, 17) % 64 >= 32).alias("top"), good.alias("good"),
            F.when(mapped, 1).otherwise(channels).alias("size"), (map_at + map_size * entry).alias("start"))

    def decoded(b: Column, h: Column) -> Column:
        n = h["width"] * h["height"]

        def samples(places: Column) -> Column:
            def pixel(p: Column) -> Column:
                y = F.floor(p / h["width"]).cast("int")
                place = F.get(places, F.when(h["top"], y).otherwise(h["height"] - 1 - y) * h["width"] + p % h["width"])
                own = F.when(h["mapped"], F.when(at(b, place) < h["map_size"], h["map_at"] + at(b, place) * h["entry"])).otherwise(place)
                channel = lambda k: F.when(own.isNull(), 0).otherwise(at(b, own + k))
                three = F.array(channel(2), channel(1), channel(0))
                return F.when(h["channels"] == 4, F.concat(three, F.array(channel(3)))).otherwise(three)

            return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), pixel))

        places = F.when(h["kind"].isin(9, 10), unpacked(b, h["start"], n, h["size"])).otherwise(count(n, lambda i: h["start"] + i * h["size"]))
        return F.when(h["good"], image(h["width"], h["height"], h["channels"], let(places, samples)))

    return let(bytes_of(data), lambda b: let(header(b), lambda h: decoded(b, h)))


def ppm(v: Column, width: int, height: int) -> Column:
    return F.concat(F.lit(f"P6\n{width} {height}\n255\n".encode()), F.unhex(hex_bytes(v)))


def reordered(v: Column, channels: int, start: Column, n: Column) -> Column:
    """n samples as blue, green, red (and alpha)."""
    return count(n, lambda i: F.get(v, start + i - i % channels + F.when(i % channels < 3, 2 - i % channels).otherwise(3)))


def bmp(v: Column, width: int, height: int, channels: int = 3) -> Column:
    """Uncompressed, rows from the bottom up and padded to four bytes."""
    row = -(-width * channels // 4) * 4
    head = "424D" + little(54 + row * height, 4) + little(0, 4) + little(54, 4) + little(40, 4) + little(width, 4) + little(height, 4) + little(1, 2) + little(channels * 8, 2) + little(0, 4) + little(row * height, 4) + little(2835, 4) * 2 + little(0, 8)
    line = lambda own, y: F.concat(hex_bytes(reordered(own, channels, (F.lit(height - 1) - y) * (width * channels), F.lit(width * channels))), F.lit("00" * (row - width * channels)))
    return F.unhex(F.concat(F.lit(head), let(v, lambda own: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: line(own, y)), ""))))


def tga(v: Column, width: int, height: int, channels: int = 4) -> Column:
    """Plain true colour, from the top down."""
    head = "000002" + "00" * 9 + little(width, 2) + little(height, 2) + little(channels * 8, 1) + "20"
    return F.unhex(F.concat(F.lit(head), let(v, lambda own: hex_bytes(reordered(own, channels, F.lit(0), F.lit(width * height * channels))))))


def woven(df: DataFrame, channels: int) -> DataFrame:
    """image_id and v of 8 x 8 images with channels side by side: red, green, blue, and alpha if there are four."""
    alpha = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 37 % 256)
    of = [lambda v, i: F.get(v, i), lambda v, i: F.get(v, (i + 21) % 64), lambda v, i: F.get(v, (i + 42) % 64), lambda v, i: F.get(alpha, i)]
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*[f(F.col("v"), i) for f in of[:channels]])))
    return df.select("image_id", whole.alias("v"))


def back(s, d, channels: int, encode, decode) -> DataFrame:
    """Every sample of images written to files and read again."""
    files = woven(images(s, d), channels).select("image_id", encode(F.col("v")).alias("file"))
    read = files.select("image_id", decode(F.col("file")).alias("im"))
    pixel = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("im.width") * F.col("im.height") - 1), lambda i: F.slice("im.v", i * channels + 1, channels)))
    rows = read.select("image_id", "im.width", pixel.alias("i", "c"))
    return rows.select("image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate("rgba"[:channels])])


OPS = {
    "ppm_back": (lambda s, d: back(s, d, 3, lambda v: ppm(v, 8, 8), netpbm), pick("image_id, x, y, r, g, b")),
    "bmp_back": (lambda s, d: back(s, d, 3, lambda v: bmp(v, 8, 8), bmp_image), pick("image_id, x, y, r, g, b")),
    "bmp_alpha_back": (lambda s, d: back(s, d, 4, lambda v: bmp(v, 8, 8, 4), bmp_image), pick("image_id, x, y, r, g, b, a")),
    "tga_back": (lambda s, d: back(s, d, 4, lambda v: tga(v, 8, 8), tga_image), pick("image_id, x, y, r, g, b, a")),
    "tga_colour_back": (lambda s, d: back(s, d, 3, lambda v: tga(v, 8, 8, 3), tga_image), pick("image_id, x, y, r, g, b")),
}
