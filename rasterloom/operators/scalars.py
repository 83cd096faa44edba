"""Queries of the colour, scalar and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, text
from ..functions.scalar import FUNCTIONS as fn
from ..oracle import PX, pick
from ..sources.tables import KEY, pixels, table

R = {c: f"({c} / CAST(255 AS DOUBLE))" for c in "rgb"}


def colors(s, d, of) -> DataFrame:
    return pixels(s, d).select(*KEY, *[F.round(v + 1e-9, 4).alias(k) for k, v in of(*(F.col(c) / 255.0 for c in "rgb")).items()])


def items(s, d, **of) -> DataFrame:
    """Functions of l_quantity (a), l_discount (b) and l_tax (c) by line."""
    a, b, c = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(f(a, b, c) + 1e-9, 4).alias(k) for k, f in of.items()])


def lines(**of: str) -> str:
    found = ", ".join(f"round(CAST({v} AS DOUBLE) + 1e-9, 4) AS {k}" for k, v in of.items())
    return f"SELECT l_orderkey, l_linenumber, {found} FROM (SELECT *, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem)"


_LIN = lambda c: f"CASE WHEN {R[c]} <= 0.04045 THEN {R[c]} / 12.92 ELSE pow(({R[c]} + 0.055) / 1.055, 2.4) END"
_ENC = lambda c: f"CASE WHEN {R[c]} <= 0.0031308 THEN {R[c]} * 12.92 ELSE pow({R[c]}, CAST(1 AS DOUBLE) / 2.4) * 1.055 - 0.055 END"
_MAX, _MIN = "greatest(r, g, b)", "least(r, g, b)"
_D = f"CAST({_MAX} - {_MIN} AS DOUBLE)"
_HUE = f"CASE WHEN {_MAX} = {_MIN} THEN 0 WHEN {_MAX} = r THEN ((g - b) / {_D} - 6 * floor((g - b) / {_D} / 6)) * 60 WHEN {_MAX} = g THEN ((b - r) / {_D} + 2) * 60 ELSE ((r - g) / {_D} + 4) * 60 END"
_XYZ = PX + f", li AS (SELECT *, {', '.join(f'{_LIN(c)} AS l{c}' for c in 'rgb')} FROM px), xz AS (SELECT *, " + ", ".join(
    f"lr * {w[0]} + lg * {w[1]} + lb * {w[2]} AS c{n}" for n, w in zip("xyz", color.TO_XYZ)) + " FROM li)"
_BEND = lambda n, w: f"CASE WHEN c{n} / {w} > CAST({color.EPSILON!r} AS DOUBLE) THEN cbrt(c{n} / {w}) ELSE (c{n} / {w} * CAST({color.KAPPA!r} AS DOUBLE) + 16) / 116 END"
_LAB = _XYZ + ", fl AS (SELECT *, " + ", ".join(f"{_BEND(n, w)} AS f{n}" for n, w in zip("xyz", color.D65)) + " FROM xz), la AS (SELECT image_id, x, y, fy * 116 - 16 AS l, (fx - fy) * 500 AS a, (fy - fz) * 200 AS b FROM fl)"


def nearest_delta(s, d) -> DataFrame:
    """The distance in Lab of each pixel from the one at its place in the next image."""
    mine = pixels(s, d).select(*KEY, *[v.alias(k) for k, v in color.lab(*(F.col(c) / 255.0 for c in "rgb")).items()])
    other = mine.select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(f"o{c}") for c in "lab"])
    both = mine.join(other, KEY)
    return both.select(*KEY, F.round(color.delta_e76({c: F.col(c) for c in "lab"}, {c: F.col(f"o{c}") for c in "lab"}), 3).alias("delta"))


def _yuv(kr: float, kb: float) -> str:
    y = f"({R['r']} * {kr} + {R['g']} * {round(1 - kr - kb, 6)} + {R['b']} * {kb})"
    return pick(f"image_id, x, y, round({y} + 1e-9, 4) AS y_, round(({R['b']} - {y}) / {2 * (1 - kb)} + 0.5 + 1e-9, 4) AS cb, round(({R['r']} - {y}) / {2 * (1 - kr)} + 0.5 + 1e-9, 4) AS cr")


def yuv(s, d, kr: float, kb: float) -> DataFrame:
    return colors(s, d, lambda r, g, b: {("y_" if k == "y" else k): v for k, v in color.ycbcr(r, g, b, kr, kb).items()})


OPS = {
    "srgb_linear": (lambda s, d: colors(s, d, lambda r, g, b: {"r": color.srgb_linear(r), "g": color.srgb_linear(g), "b": color.srgb_linear(b)}), pick("image_id, x, y, " + ", ".join(f"round({_LIN(c)} + 1e-9, 4) AS {c}" for c in "rgb"))),
    "srgb_encoded": (lambda s, d: colors(s, d, lambda r, g, b: {"r": color.srgb_encoded(r), "g": color.srgb_encoded(g), "b": color.srgb_encoded(b)}), pick("image_id, x, y, " + ", ".join(f"round({_ENC(c)} + 1e-9, 4) AS {c}" for c in "rgb"))),
    "hsv": (lambda s, d: colors(s, d, color.hsv), pick(f"image_id, x, y, round({_HUE} + 1e-9, 4) AS h, round(CASE WHEN {_MAX} > 0 THEN {_D} / {_MAX} ELSE 0 END + 1e-9, 4) AS s, round({_MAX} / CAST(255 AS DOUBLE) + 1e-9, 4) AS v")),
    "hsl": (lambda s, d: colors(s, d, color.hsl), pick(f"image_id, x, y, round({_HUE} + 1e-9, 4) AS h, round(CASE WHEN {_MAX} = {_MIN} THEN 0 ELSE {_D} / 255 / (1 - abs(({_MAX} + {_MIN}) / CAST(255 AS DOUBLE) - 1)) END + 1e-9, 4) AS s, round(({_MAX} + {_MIN}) / CAST(510 AS DOUBLE) + 1e-9, 4) AS l")),
    "ycbcr_601": (lambda s, d: yuv(s, d, 0.299, 0.114), _yuv(0.299, 0.114)),
    "ycbcr_709": (lambda s, d: yuv(s, d, 0.2126, 0.0722), _yuv(0.2126, 0.0722)),
    "xyz": (lambda s, d: pixels(s, d).select(*KEY, *[F.round(v, 4).alias(f"c{k}") for k, v in color.xyz(*(F.col(c) / 255.0 for c in "rgb")).items()]), _XYZ + " SELECT image_id, x, y, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz FROM xz"),
    "lab": (lambda s, d: colors(s, d, color.lab), _LAB + " SELECT image_id, x, y, round(l + 1e-9, 4) AS l, round(a + 1e-9, 4) + 0.0 AS a, round(b + 1e-9, 4) + 0.0 AS b FROM la"),
    "delta_e76": (nearest_delta, _LAB + " SELECT p.image_id, p.x, p.y, round(sqrt((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), 3) AS delta FROM la p JOIN la q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y"),
    "scalar_trigonometry": (
        lambda s, d: items(s, d, sin_=lambda a, b, c: fn["sin"](a), cos_=lambda a, b, c: fn["cos"](a), atan2_=lambda a, b, c: fn["atan2"](b, a), asin_=lambda a, b, c: fn["asin"](a), acos_=lambda a, b, c: fn["acos"](b), deg_=lambda a, b, c: fn["deg"](b), hypot_=lambda a, b, c: fn["hypot"](b, c)),
        lines(sin_="sin(a)", cos_="cos(a)", atan2_="atan2(b, a)", asin_="asin(least(1.0, a))", acos_="acos(b)", deg_="degrees(b)", hypot_="sqrt(b * b + c * c)")),
    "scalar_powers": (
        lambda s, d: items(s, d, sqrt_=lambda a, b, c: fn["sqrt"](a), pow_=lambda a, b, c: fn["pow"](a, b), exp_=lambda a, b, c: fn["exp"](b), ln_=lambda a, b, c: fn["log"](a), log2_=lambda a, b, c: fn["log2"](a), log10_=lambda a, b, c: fn["log10"](a)),
        lines(sqrt_="sqrt(a)", pow_="pow(a, b)", exp_="exp(b)", ln_="ln(a)", log2_="log2(a)", log10_="log10(a)")),
    "scalar_rounding": (
        lambda s, d: items(s, d, floor_=lambda a, b, c: fn["floor"](a * b), ceil_=lambda a, b, c: fn["ceil"](a * b), trunc_=lambda a, b, c: fn["trunc"](b - c), fract_=lambda a, b, c: fn["fract"](a * b), sign_=lambda a, b, c: fn["sign"](b - c)),
        lines(floor_="floor(a * b)", ceil_="ceil(a * b)", trunc_="trunc(b - c)", fract_="a * b - floor(a * b)", sign_="CAST(sign(b - c) AS DOUBLE)")),
    "scalar_blends": (
        lambda s, d: items(s, d, clamp_=lambda a, b, c: fn["clamp"](a, F.lit(30.0), F.lit(10.0)), saturate_=lambda a, b, c: fn["saturate"](a - 25), mix_=lambda a, b, c: fn["mix"](a, c, b), smooth_=lambda a, b, c: fn["smoothstep"](F.lit(10.0), F.lit(40.0), a), step_=lambda a, b, c: fn["step"](a, F.lit(25.0)), select_=lambda a, b, c: fn["select"](c, a, b)),
        lines(clamp_="greatest(10.0, least(30.0, a))", saturate_="greatest(0.0, least(1.0, a - 25))", mix_="a + (c - a) * b", smooth_="pow(greatest(0.0, least(1.0, (a - 10) / 30)), 2) * (3 - 2 * greatest(0.0, least(1.0, (a - 10) / 30)))", step_="CASE WHEN a < 25 THEN 0.0 ELSE 1.0 END", select_="CASE WHEN abs(c) > 1e-12 THEN a ELSE b END")),
    "scalar_variadic": (
        lambda s, d: items(s, d, min_=lambda *x: fn["min"](*x), max_=lambda *x: fn["max"](*x), sum_=lambda *x: fn["sum"](*x), avg_=lambda *x: fn["avg"](*x), modulo_=lambda a, b, c: fn["modulo"](a, b + 1)),
        lines(min_="least(a, b, c)", max_="greatest(a, b, c)", sum_="a + b + c", avg_="(a + b + c) / 3", modulo_="a % (b + 1)")),
    "base64_text": (lambda s, d: table(s, d, "benchmark").select("item_id", text.base64_encoded(F.col("text")).alias("code"), text.base64_lenient(text.base64_encoded(F.col("text"))).cast("string").alias("back")), "SELECT item_id, to_base64(encode(text)) AS code, text AS back FROM benchmark"),
    "hex_text": (lambda s, d: table(s, d, "benchmark").select("item_id", F.lower(F.hex("text")).alias("code"), text.hex_decoded(F.concat(F.lit(" 0x"), F.hex("text"))).cast("string").alias("back")), "SELECT item_id, lower(hex(encode(text))) AS code, text AS back FROM benchmark"),
    "base64_documents": (lambda s, d: table(s, d, "documents").select("doc_id", text.base64_encoded(F.col("text")).alias("code"), text.base64_lenient(text.base64_encoded(F.col("text"))).cast("string").alias("back")), "SELECT doc_id, to_base64(encode(text)) AS code, text AS back FROM documents"),
    "hex_documents": (lambda s, d: table(s, d, "documents").select("doc_id", F.lower(F.hex("text")).alias("code"), text.hex_decoded(F.concat(F.lit(" 0x"), F.hex("text"))).cast("string").alias("back")), "SELECT doc_id, lower(hex(encode(text))) AS code, text AS back FROM documents"),
    "trim_documents": (lambda s, d: table(s, d, "documents").select("doc_id", text.trim(F.col("text")).alias("text")), "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents"),
    "glob_urls": (lambda s, d: table(s, d, "pages").select("page_id", text.glob(F.col("url"), "http?://*.example.net/*").alias("fits")), "SELECT page_id, url GLOB 'http?://*.example.net/*' AS fits FROM pages"),
    "split_urls": (lambda s, d: table(s, d, "pages").select("page_id", F.explode(text.split(F.col("url"), "/")).alias("part")), "SELECT page_id, unnest(CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END) AS part FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)"),
    "trim_words": (lambda s, d: table(s, d, "benchmark").select("item_id", text.trim(F.col("text")).alias("start")), "SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS start FROM benchmark"),
}
