"""Palette files (GPL text, ACO bytes) written and read by built-in functions, colours in bytes, and errors diffused both ways."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, text
from ..functions.scalar import FUNCTIONS as fn
from ..oracle import PX
from ..sources.tables import KEY, images, pixels, table
from .aggregates import _HOUGH, hough
from .neighbourhood import as_pixels
from .palettes import _RANKED, by_frequency
from .scalars import items, lines
from .sequential import per_stack

#: The first line of GPL files.
GPL_HEAD = "GIMP Palette"


def gpl(colours: Column, name: str = "palette") -> Column:
    """A GPL file of an array of structs r, g, b."""
    line = lambda p: F.format_string("%3d %3d %3d\tcolour", p["r"], p["g"], p["b"])
    return F.concat(F.lit(f"{GPL_HEAD}\nName: {name}\nColumns: 0\n#\n"), F.array_join(F.transform(colours, line), "\n"), F.lit("\n"))


def from_gpl(file: Column) -> Column:
    """The colours of a GPL file, held to 0..255; lines that don't begin with three numbers don't count; null if it is no such file."""
    rows = F.filter(F.split(file, "\r?\n"), lambda r: r.rlike(r"^\s*\d+\s+\d+\s+\d+(\s|$)"))
    part = lambda r, k: F.least(F.regexp_extract(r, r"^\s*(\d+)\s+(\d+)\s+(\d+)", k).try_cast("int"), F.lit(255))
    found = F.transform(rows, lambda r: F.struct(*[F.coalesce(part(r, k + 1), F.lit(255)).alias(c) for k, c in enumerate("rgb")]))
    return F.when(file.startswith(GPL_HEAD), found)


def aco(colours: Column) -> Column:
    """An ACO file (version 1) of an array of structs r, g, b."""
    word = lambda v: F.lpad(F.hex(v), 4, "0")
    each = F.transform(colours, lambda p: F.concat(F.lit("0000"), *[word(p[c] * 257) for c in "rgb"], F.lit("0000")))
    return F.unhex(F.concat(F.lit("0001"), word(F.size(colours)), F.array_join(each, "")))


def from_aco(file: Column) -> Column:
    """The RGB colours of an ACO file, as far as they are there; entries in other spaces go; null if it is no such file."""
    word = lambda at: F.conv(F.substr(F.hex(file), at * 4 + 1, F.lit(4)), 16, 10).cast("int")
    there = F.floor((F.length(file) - 4) / 10).cast("int")
    count = F.least(word(F.lit(1)), there)
    every = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(
        word(i * 5 + 2).alias("space"), *[F.floor(word(i * 5 + 3 + k) / 257).cast("int").alias(c) for k, c in enumerate("rgb")])))
    rgb = F.transform(F.filter(every, lambda p: p["space"] == 0), lambda p: F.struct(*[p[c].alias(c) for c in "rgb"]))
    return F.when((F.length(file) >= 4) & (word(F.lit(0)) == 1), F.coalesce(rgb, F.array().cast("array<struct<r:int,g:int,b:int>>")))


def palettes_of(s, d, most: int = 16) -> DataFrame:
    """image_id, colours: the commonest colours of each image."""
    ranked = by_frequency(pixels(s, d)).filter(F.col("place") <= most)
    row = F.struct("place", *[F.col(c).cast("int").alias(c) for c in "rgb"])
    return ranked.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda p: F.struct(*[p[c].alias(c) for c in "rgb"])).alias("colours"))


def back(s, d, write, read) -> DataFrame:
    found = palettes_of(s, d).select("image_id", write(F.col("colours")).alias("file")).select("image_id", F.posexplode(read(F.col("file"))).alias("k", "p"))
    return found.select("image_id", (F.col("k") + 1).alias("place"), "p.*")


def both_ways(stack: np.ndarray, level: float = 128) -> np.ndarray:
    """Black and white by error diffusion, rows in turn from the left and from the right, with the shares mirrored."""
    n, h, w = stack.shape
    rest = np.zeros((n, h + 1, w + 2), np.float32)
    rest[:, :h, 1 : w + 1] = stack
    out = np.zeros(stack.shape, np.int64)
    for y in range(h):
        ahead = 1 if y % 2 == 0 else -1
        for x in range(w)[::ahead]:
            old = rest[:, y, x + 1]
            out[:, y, x] = chosen = np.where(old >= level, 255, 0)
            error = old - chosen.astype(np.float32)
            for dx, dy, share in ((ahead, 0, 7), (-ahead, 1, 3), (0, 1, 5), (ahead, 1, 1)):
                rest[:, y + dy, x + 1 + dx] += error * np.float32(share / 16)
    return out


def whole_byte(v: Column) -> Column:
    return F.floor(F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0, 6)).cast("int")


def recoloured(s, d, to, change, back_) -> DataFrame:
    """Pixels taken to another space, changed there, and brought back to whole bytes."""
    there = to(*(F.col(c) / 255.0 for c in "rgb"))
    moved = pixels(s, d).select(*KEY, F.struct(*[v.cast("double").alias(k) for k, v in there.items()]).alias("p"))
    rgb = back_(*change({k: F.col(f"p.{k}") for k in there}).values())
    return moved.select(*KEY, *[whole_byte(v).alias(c) for c, v in rgb.items()])


_BACK = _RANKED + " SELECT image_id, CAST(place AS INTEGER) AS place, r, g, b FROM ra WHERE place <= 16"
_U = ", ".join(f"{c} / CAST(255 AS DOUBLE) AS u{c}" for c in "rgb")
_HUE = f"""{PX}, u AS (SELECT image_id, x, y, {_U} FROM px), m AS (SELECT *, greatest(ur, ug, ub) AS mx, least(ur, ug, ub) AS mn FROM u),
h AS (SELECT *, mx - mn AS d, CASE WHEN mx = mn THEN 0 WHEN mx = ur THEN (ug - ub) / (mx - mn) WHEN mx = ug THEN (ub - ur) / (mx - mn) + 2 ELSE (ur - ug) / (mx - mn) + 4 END AS h0 FROM m),
k AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 6 ELSE h0 END AS h6 FROM h)"""


def _back_sql(span: str, low: str) -> str:
    """Bytes of hue h6 (0 to 6) with the channels between low and low + span."""
    f = "abs(h6 - 2 * floor(h6 / 2) - 1)"
    c = {"r": f"CASE WHEN h6 < 1 OR h6 >= 5 THEN 1 WHEN h6 < 2 OR h6 >= 4 THEN 1 - {f} ELSE 0 END", "g": f"CASE WHEN h6 < 1 THEN 1 - {f} WHEN h6 < 3 THEN 1 WHEN h6 < 4 THEN 1 - {f} ELSE 0 END", "b": f"CASE WHEN h6 < 2 THEN 0 WHEN h6 < 3 THEN 1 - {f} WHEN h6 < 5 THEN 1 ELSE 1 - {f} END"}
    return _HUE + ", z AS (SELECT *, " + f"{span} AS sp, {low} AS lo FROM k) SELECT image_id, x, y, " + ", ".join(f"CAST(floor(round(least(1, greatest(0, lo + sp * ({v}))) * 255, 6)) AS INTEGER) AS {n}" for n, v in c.items()) + " FROM z"


_LIGHT = "((mx + mn) / 2)"
_SAT = f"(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs({_LIGHT} * 2 - 1)) END)"
_NEW = f"({_LIGHT} * 0.8)"

OPS = {
    "palette_gpl": (lambda s, d: back(s, d, gpl, from_gpl), _BACK),
    "palette_aco": (lambda s, d: back(s, d, aco, from_aco), _BACK),
    "error_diffusion_both_ways": (lambda s, d: as_pixels(per_stack(images(s, d), both_ways)), None),
    "hsv_bytes": (lambda s, d: recoloured(s, d, color.hsv, lambda c: {"h": c["h"], "s": c["s"] * 0.5, "v": c["v"]}, color.hsv_to_rgb), _back_sql("d * 0.5", "mx - d * 0.5")),
    "hsl_bytes": (lambda s, d: recoloured(s, d, color.hsl, lambda c: {"h": c["h"], "s": c["s"], "l": c["l"] * 0.8}, color.hsl_to_rgb), _back_sql(f"(1 - abs({_NEW} * 2 - 1)) * {_SAT}", f"{_NEW} - (1 - abs({_NEW} * 2 - 1)) * {_SAT} / 2")),
    "hough_lines_ranked": (lambda s, d: hough(images(s, d), 5), f"SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, theta, rho) AS INTEGER) AS place FROM ({_HOUGH})"),
    "scalar_more": (
        lambda s, d: items(
            s, d, add_=lambda a, b, c: a + b, subtract_=lambda a, b, c: a - c, multiply_=lambda a, b, c: a * b, divide_=lambda a, b, c: fn["divide"](a, b + 1), negate_=lambda a, b, c: -a, power_=lambda a, b, c: fn["pow"](b, c),
            tan_=lambda a, b, c: fn["tan"](b), atan_=lambda a, b, c: fn["atan"](a), rad_=lambda a, b, c: fn["rad"](a), abs_=lambda a, b, c: fn["abs"](b - c), round_=lambda a, b, c: fn["round"](a * b), lerp_=lambda a, b, c: fn["lerp"](a, b, c), isfinite_=lambda a, b, c: fn["isfinite"](a), equal_=lambda a, b, c: fn["equal"](b, c)),
        lines(add_="a + b", subtract_="a - c", multiply_="a * b", divide_="a / (b + 1)", negate_="-a", power_="pow(b, c)", tan_="tan(b)", atan_="atan(a)", rad_="radians(a)", abs_="abs(b - c)", round_="round(a * b)", lerp_="a + (b - a) * c", isfinite_="1.0", equal_="CASE WHEN abs(b - c) <= 1e-12 THEN 1 ELSE 0 END")),
    "trimmed_and_joined": (
        lambda s, d: table(s, d, "documents").select("doc_id", text.ltrim(F.col("text")).alias("l"), text.rtrim(F.col("text")).alias("r"), text.join(F.split(F.col("text"), "\n"), "|").alias("j")),
        "SELECT doc_id, ltrim(text, w) AS l, rtrim(text, w) AS r, replace(text, chr(10), '|') AS j FROM (SELECT *, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS w FROM documents)"),
}
