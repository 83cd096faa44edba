"""Colour functions on Columns.  Channels are doubles of 0 to 1; results that aren't scalars are dicts of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ and back (D65), the D65 white, and the constants of CIE Lab.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
D65 = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 216 / 24389, 24389 / 27


def unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def srgb_linear(v: Column) -> Column:
    v = unit(v)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def srgb_encoded(v: Column) -> Column:
    v = unit(v)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees of 0 to 360; 0 for grays."""
    most, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    safe = F.when(span > 0, span)
    turn = F.when(most == r, F.pmod((g - b) / safe, F.lit(6.0))).when(most == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    return F.when(span <= 0, 0.0).otherwise(turn * 60)


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    return {"h": hue(r, g, b), "s": F.when(most > 0, (most - least) / most).otherwise(0.0), "v": most}


def hsl(r: Column, g: Column, b: Column) -> dict[str, Column]:
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    light = (most + least) / 2
    return {"h": hue(r, g, b), "s": F.when(most == least, 0.0).otherwise((most - least) / (1.0 - F.abs(light * 2 - 1.0))), "l": light}


def ycbcr(r: Column, g: Column, b: Column, kr: float = 0.299, kb: float = 0.114) -> dict[str, Column]:
    """Chroma around 0.5; the defaults are those of BT.601, BT.709 has 0.2126 and 0.0722."""
    y = r * kr + g * (1 - kr - kb) + b * kb
    return {"y": y, "cb": (b - y) / (2 * (1 - kb)) + 0.5, "cr": (r - y) / (2 * (1 - kr)) + 0.5}


def xyz(r: Column, g: Column, b: Column) -> dict[str, Column]:
    line = [srgb_linear(c) for c in (r, g, b)]
    return {n: line[0] * w[0] + line[1] * w[1] + line[2] * w[2] for n, w in zip(("x", "y", "z"), TO_XYZ)}


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    bend = lambda t: F.when(t > EPSILON, F.cbrt(t)).otherwise((t * KAPPA + 16) / 116)
    fx, fy, fz = (bend(v / w) for v, w in zip(xyz(r, g, b).values(), D65))
    return {"l": fy * 116 - 16, "a": (fx - fy) * 500, "b": (fy - fz) * 200}


def delta_e76(one: dict[str, Column], two: dict[str, Column]) -> Column:
    return F.sqrt(sum(((one[k] - two[k]) * (one[k] - two[k]) for k in "la"), (one["b"] - two["b"]) * (one["b"] - two["b"])))


def from_hue(h: Column, span: Column, low: Column) -> dict[str, Column]:
    """Red, green and blue of a hue in degrees, from the smallest channel and the span between smallest and largest."""
    turn = F.pmod(h / 60, F.lit(6.0))
    part = lambda shift: unit(F.abs(F.pmod(turn + shift, F.lit(6.0)) - 3) - 1)
    return {c: part(shift) * span + low for c, shift in (("r", 0), ("g", 4), ("b", 2))}


def hsv_to_rgb(h: Column, s: Column, v: Column) -> dict[str, Column]:
    return from_hue(h, v * s, v - v * s)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> dict[str, Column]:
    span = (F.lit(1.0) - F.abs(light * 2 - 1)) * s
    return from_hue(h, span, light - span / 2)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, kr: float = 0.299, kb: float = 0.114) -> dict[str, Column]:
    r, b = y + (cr - 0.5) * (2 * (1 - kr)), y + (cb - 0.5) * (2 * (1 - kb))
    return {"r": unit(r), "g": unit((y - r * kr - b * kb) / (1 - kr - kb)), "b": unit(b)}


def cmyk(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Inks with as much black as all three have in common; of black, black alone."""
    inks = {"c": 1 - unit(r), "m": 1 - unit(g), "y": 1 - unit(b)}
    k = F.least(*inks.values())
    return {n: F.when(k >= 1 - 1e-7, 0.0).otherwise(unit((v - k) / (1 - k))) for n, v in inks.items()} | {"k": F.when(k >= 1 - 1e-7, 1.0).otherwise(k)}


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> dict[str, Column]:
    return {n: (1 - unit(v)) * (1 - unit(k)) for n, v in (("r", c), ("g", m), ("b", y))}


def delta_e2000(one: dict[str, Column], two: dict[str, Column]) -> Column:
    """The CIE distance of 2000 between two colours in Lab, with all weights 1."""
    seven = lambda v: F.pow(v, F.lit(7.0))
    mean_c = (F.hypot(one["a"], one["b"]) + F.hypot(two["a"], two["b"])) / 2
    stretch = (1 - F.sqrt(seven(mean_c) / (seven(mean_c) + 25.0**7))) * 0.5 + 1
    a1, a2 = one["a"] * stretch, two["a"] * stretch
    c1, c2 = F.hypot(a1, one["b"]), F.hypot(a2, two["b"])
    angle = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = angle(a1, one["b"]), angle(a2, two["b"])
    gray, apart = c1 * c2 == 0, h2 - h1
    turn = F.when(gray, 0.0).when(F.abs(apart) <= 180, apart).when(apart > 180, apart - 360).otherwise(apart + 360)
    d_l, d_c, d_h = two["l"] - one["l"], c2 - c1, F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2)) * 2
    mean_l, mean_c2, both = (one["l"] + two["l"]) / 2, (c1 + c2) / 2, h1 + h2
    mean_h = F.when(gray, both).when(F.abs(apart) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)
    cos = lambda v: F.cos(F.radians(v))
    t = 1 - cos(mean_h - 30) * 0.17 + cos(mean_h * 2) * 0.24 + cos(mean_h * 3 + 6) * 0.32 - cos(mean_h * 4 - 63) * 0.20
    off = (mean_l - 50) * (mean_l - 50)
    s_l, s_c, s_h = 1 + off * 0.015 / F.sqrt(off + 20), 1 + mean_c2 * 0.045, 1 + mean_c2 * t * 0.015
    swing = F.exp(-((mean_h - 275) / 25) * ((mean_h - 275) / 25)) * 30
    r_t = -F.sin(F.radians(swing * 2)) * 2 * F.sqrt(seven(mean_c2) / (seven(mean_c2) + 25.0**7))
    l, c, h = d_l / s_l, d_c / s_c, d_h / s_h
    return F.sqrt(l * l + c * c + h * h + r_t * c * h)
