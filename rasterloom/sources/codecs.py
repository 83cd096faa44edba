"""Binary image files as Columns: PGM and BMP, written and read with built-in functions.

Files come from spark.read.format("binaryFile"), so a file is a row; bytes are handled as hexadecimal text inside
one expression, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..oracle import PX
from .tables import SIDE, images


def hex_bytes(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), "")


def little(value: int, size: int) -> str:
    return value.to_bytes(size, "little").hex().upper()


def pgm(values: Column, width: int, height: int) -> Column:
    """A binary gray map."""
    return F.concat(F.lit(f"P5\n{width} {height}\n255\n".encode()), F.unhex(hex_bytes(values)))


def read_pgm(data: Column) -> dict[str, Column]:
    """width, height and v of a binary gray map with one-byte samples; null where it isn't one; missing samples are 0."""
    text = F.decode(data, "ISO-8859-1")
    gap = r"\s++(?:#[^\n]*+\n\s*+)*+"  # possessive: no stack for each comment
    pattern = rf"(?s)^P5{gap}(\d+){gap}(\d+){gap}(\d+)\s"
    head = F.regexp_extract(text, pattern, 0)
    number = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    width, height = number(1), number(2)
    body = F.hex(F.substring(data, F.length(head) + 1, width * height))
    v = F.transform(F.sequence(F.lit(0), width * height - 1), lambda i: F.coalesce(F.conv(F.substring(body, i * 2 + 1, F.lit(2)), 16, 10).try_cast("int"), F.lit(0)))
    good = F.length(head) > 0
    return {"width": F.when(good, width), "height": F.when(good, height), "v": F.when(good & (width * height > 0), v)}


def bmp(values: Column, width: int, height: int) -> Column:
    """An uncompressed 24-bit file of gray samples, rows from the bottom up, padded to four bytes."""
    row = -(-width * 3 // 4) * 4
    size = 54 + row * height
    head = "424D" + little(size, 4) + little(0, 4) + little(54, 4) + little(40, 4) + little(width, 4) + little(height, 4) + little(1, 2) + little(24, 2) + little(0, 4) + little(row * height, 4) + little(2835, 4) * 2 + little(0, 8)
    pad = F.lit("00" * (row - width * 3))
    line = lambda y: F.concat(F.array_join(F.transform(F.slice(values, (F.lit(height - 1) - y) * width + 1, width), lambda x: F.repeat(F.lpad(F.hex(x), 2, "0"), 3)), ""), pad)
    return F.unhex(F.concat(F.lit(head), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line), "")))


def written(df: DataFrame, encode) -> DataFrame:
    return df.select("image_id", F.hex(encode(F.col("v"), SIDE, SIDE)).alias("file"))


def read_back(df: DataFrame) -> DataFrame:
    found = read_pgm(pgm(F.col("v"), SIDE, SIDE))
    return df.select("image_id", found["width"].alias("width"), found["height"].alias("height"), F.posexplode(found["v"]).alias("i", "v")).drop("i").groupBy("image_id", "width", "height").agg(F.sum("v").alias("total"))


_HEX = lambda v: f"lpad(upper(to_hex({v})), 2, '0')"
_BMP = "424D" + little(54 + 192, 4) + little(0, 4) + little(54, 4) + little(40, 4) + little(8, 4) * 2 + little(1, 2) + little(24, 2) + little(0, 4) + little(192, 4) + little(2835, 4) * 2 + little(0, 8)

OPS = {
    "write_pgm": (lambda s, d: written(images(s, d), pgm), f"{PX} SELECT image_id, '{b'P5\n8 8\n255\n'.hex().upper()}' || string_agg({_HEX('v')}, '' ORDER BY y, x) AS file FROM gr GROUP BY image_id"),
    "write_bmp": (lambda s, d: written(images(s, d), bmp), f"{PX} SELECT image_id, '{_BMP}' || string_agg({_HEX('v')} || {_HEX('v')} || {_HEX('v')}, '' ORDER BY y DESC, x) AS file FROM gr GROUP BY image_id"),
    "read_pgm": (lambda s, d: read_back(images(s, d)), f"{PX} SELECT image_id, 8 AS width, 8 AS height, CAST(sum(v) AS BIGINT) AS total FROM gr GROUP BY image_id"),
}
