"""Queries of transfer curves, colour spaces, and conversions back to RGB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, spaces
from ..oracle import PX, pick
from ..sources.tables import KEY, pixels
from .scalars import _LAB, R, colors


def curves(s, d) -> DataFrame:
    """Each curve of red both ways."""
    v = F.col("r") / 255.0
    both = [(f"{name}_{side}", f(v)) for name, pair in spaces.CURVES.items() for side, f in zip(("linear", "encoded"), pair)]
    return pixels(s, d).select(*KEY, *[F.round(c + 1e-9, 4).alias(n) for n, c in both])


def _curves_sql() -> str:
    v, pq, hlg = R["r"], {k: f"CAST({x!r} AS DOUBLE)" for k, x in spaces.PQ.items()}, spaces.HLG
    two = {
        "linear": (v, v),
        "srgb": (f"CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END", f"CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1 / 2.4) - 0.055 END"),
        "gamma22": (f"pow({v}, 2.2)", f"pow({v}, 1 / 2.2)"), "gamma28": (f"pow({v}, 2.8)", f"pow({v}, 1 / 2.8)"),
        "adobe": (f"pow({v}, 2.19921875)", f"pow({v}, 1 / 2.19921875)"),
        "prophoto": (f"CASE WHEN {v} <= 0.03125 THEN {v} / 16 ELSE pow({v}, 1.8) END", f"CASE WHEN {v} <= 0.001953125 THEN {v} * 16 ELSE pow({v}, 1 / 1.8) END"),
        "pq": (
            f"pow(greatest(pow({v}, 1 / {pq['m2']}) - {pq['c1']}, 0) / ({pq['c2']} - {pq['c3']} * pow({v}, 1 / {pq['m2']})), 1 / {pq['m1']})",
            f"CASE WHEN {v} = 0 THEN 0 ELSE pow(({pq['c1']} + {pq['c2']} * pow({v}, {pq['m1']})) / (1 + {pq['c3']} * pow({v}, {pq['m1']})), {pq['m2']}) END"),
        "hlg": (
            f"CASE WHEN {v} >= 1 THEN 1 WHEN {v} <= 0.5 THEN {v} * {v} / 3 ELSE (exp(({v} - {hlg['c']}) / {hlg['a']}) + {hlg['b']}) / 12 END",
            f"CASE WHEN {v} >= 1 THEN 1 WHEN {v} <= CAST(1 AS DOUBLE) / 12 THEN sqrt(3 * {v}) ELSE {hlg['a']} * ln(12 * {v} - {hlg['b']}) + {hlg['c']} END"),
    }
    return pick("image_id, x, y, " + ", ".join(f"round(CAST({e} AS DOUBLE) + 1e-9, 4) AS {n}_{side}" for n, pair in two.items() for side, e in zip(("linear", "encoded"), pair)))


def back(s, d, there, again) -> DataFrame:
    """Colours taken to another model and back, as bytes."""
    rgb = again(*there(*(F.col(c) / 255.0 for c in "rgb")).values())
    return pixels(s, d).select(*KEY, *[F.round(rgb[c] * 255).cast("int").alias(c) for c in "rgb"])


def inks(s, d) -> DataFrame:
    names = {"c": "cyan", "m": "magenta", "y": "yellow", "k": "black"}
    return colors(s, d, lambda r, g, b: {names[k]: v for k, v in color.cmyk(r, g, b).items()})


def lab_back(s, d) -> DataFrame:
    there = color.lab(*(F.col(c) / 255.0 for c in "rgb"))
    line = spaces.lab_to_linear(there["l"], there["a"], there["b"])
    return pixels(s, d).select(*KEY, *[F.round(color.srgb_encoded(v) * 255).cast("int").alias(c) for c, v in zip("rgb", line)])


def xyz_back(s, d) -> DataFrame:
    line = spaces.applied(spaces.inverse(color.TO_XYZ), list(color.xyz(*(F.col(c) / 255.0 for c in "rgb")).values()))
    return pixels(s, d).select(*KEY, *[F.round(color.srgb_encoded(v) * 255).cast("int").alias(c) for c, v in zip("rgb", line)])


def converted(s, d, target: str) -> DataFrame:
    return pixels(s, d).select(*KEY, *[F.round(v + 1e-9, 4).alias(c) for c, v in zip("rgb", spaces.converted([F.col(c) / 255.0 for c in "rgb"], "srgb", target))])


def _converted_sql(target: str, encode) -> str:
    m = spaces.between("srgb", target)
    line = lambda c: f"CASE WHEN {R[c]} <= 0.04045 THEN {R[c]} / 12.92 ELSE pow(({R[c]} + 0.055) / 1.055, 2.4) END"
    rows = ", ".join(f"greatest(0, least(1, lr * CAST({w[0]!r} AS DOUBLE) + lg * CAST({w[1]!r} AS DOUBLE) + lb * CAST({w[2]!r} AS DOUBLE))) AS {c}" for c, w in zip("rgb", m))
    return (PX + f", li AS (SELECT image_id, x, y, {', '.join(f'{line(c)} AS l{c}' for c in 'rgb')} FROM px), co AS (SELECT image_id, x, y, {rows} FROM li) "
            f"SELECT image_id, x, y, {', '.join(f'round({encode(c)} + 1e-9, 4) AS {c}' for c in 'rgb')} FROM co")


def gamut(s, d) -> DataFrame:
    """Colours with their contrast raised: whether they are colours still, and clipped to what is one."""
    rgb = [(F.col(c) / 255.0 - 0.5) * 1.3 + 0.5 for c in "rgb"]
    return pixels(s, d).select(*KEY, spaces.in_gamut(rgb).alias("fits"), *[F.round(color.unit(v) + 1e-9, 4).alias(c) for c, v in zip("rgb", rgb)])


def looked_up(s, d) -> DataFrame:
    """Blue in linear light by a table of 4,096 points, a literal of the plan."""
    points = s.range(1).select(spaces.lookup(spaces.CURVES["srgb"][0])).first()[0]
    return pixels(s, d).select(*KEY, F.round(spaces.looked_up(F.lit(points), F.col("b") / 255.0) + 1e-9, 5).alias("b"))


def delta_e2000(s, d) -> DataFrame:
    """The distance of each pixel from the one at its place in the next image."""
    mine = pixels(s, d).select(*KEY, *[v.alias(k) for k, v in color.lab(*(F.col(c) / 255.0 for c in "rgb")).items()])
    other = mine.select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(f"o{c}") for c in "lab"])
    return mine.join(other, KEY).select(*KEY, F.round(color.delta_e2000({c: F.col(c) for c in "lab"}, {c: F.col(f"o{c}") for c in "lab"}), 3).alias("delta"))


_S7 = lambda v: f"sqrt(pow({v}, 7) / (pow({v}, 7) + 6103515625.0))"
_CIE2000 = _LAB + f""", p0 AS (SELECT p.image_id, p.x, p.y, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM la p JOIN la q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y),
p1 AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM p0),
p2 AS (SELECT *, a1 * (1 + 0.5 * (1 - {_S7('cm')})) AS u1, a2 * (1 + 0.5 * (1 - {_S7('cm')})) AS u2 FROM p1),
p3 AS (SELECT *, sqrt(u1 * u1 + b1 * b1) AS c1, sqrt(u2 * u2 + b2 * b2) AS c2, CASE WHEN b1 = 0 AND u1 = 0 THEN 0 WHEN atan2(b1, u1) < 0 THEN degrees(atan2(b1, u1)) + 360 ELSE degrees(atan2(b1, u1)) END AS h1,
  CASE WHEN b2 = 0 AND u2 = 0 THEN 0 WHEN atan2(b2, u2) < 0 THEN degrees(atan2(b2, u2)) + 360 ELSE degrees(atan2(b2, u2)) END AS h2 FROM p2),
p4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (c1 + c2) / 2 AS cc, (l1 + l2) / 2 - 50 AS lo FROM p3),
p5 AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t FROM p4),
p6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * lo * lo / sqrt(20 + lo * lo)) AS dl, (c2 - c1) / (1 + 0.045 * cc) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cc * t) AS d_h,
  -2 * {_S7('cc')} * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS rt FROM p5)
SELECT image_id, x, y, round(sqrt(dl * dl + dc * dc + d_h * d_h + rt * dc * d_h), 3) AS delta FROM p6"""
_K = "least(1 - r / CAST(255 AS DOUBLE), 1 - g / CAST(255 AS DOUBLE), 1 - b / CAST(255 AS DOUBLE))"
_INK = lambda c: f"CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (1 - {c} / CAST(255 AS DOUBLE) - {_K}) / (1 - {_K}) END"
_SAME = pick("image_id, x, y, r, g, b")

OPS = {
    "transfer_curves": (curves, _curves_sql()),
    "curve_lookup": (looked_up, PX + ", lt AS (SELECT list_transform(range(4096), lambda i: CASE WHEN i / CAST(4095 AS DOUBLE) <= 0.04045 THEN i / CAST(4095 AS DOUBLE) / 12.92 ELSE pow((i / CAST(4095 AS DOUBLE) + 0.055) / 1.055, 2.4) END) AS p), "
                     "pl AS (SELECT image_id, x, y, b / CAST(255 AS DOUBLE) * 4095 AS t, CAST(least(floor(b / CAST(255 AS DOUBLE) * 4095), 4094) AS INTEGER) AS k, p FROM px, lt) SELECT image_id, x, y, round(p[k + 1] + (p[k + 2] - p[k + 1]) * (t - k) + 1e-9, 5) AS b FROM pl"),
    "hsv_back": (lambda s, d: back(s, d, color.hsv, color.hsv_to_rgb), _SAME),
    "hsl_back": (lambda s, d: back(s, d, color.hsl, color.hsl_to_rgb), _SAME),
    "ycbcr_back": (lambda s, d: back(s, d, color.ycbcr, color.ycbcr_to_rgb), _SAME),
    "cmyk_back": (lambda s, d: back(s, d, color.cmyk, color.cmyk_to_rgb), _SAME),
    "xyz_back": (xyz_back, _SAME),
    "lab_back": (lab_back, _SAME),
    "cmyk": (inks, pick(f"image_id, x, y, round({_INK('r')} + 1e-9, 4) AS cyan, round({_INK('g')} + 1e-9, 4) AS magenta, round({_INK('b')} + 1e-9, 4) AS yellow, round({_K} + 1e-9, 4) AS black")),
    "convert_adobe": (lambda s, d: converted(s, d, "adobe"), _converted_sql("adobe", lambda c: f"pow({c}, 1 / 2.19921875)")),
    "convert_p3": (lambda s, d: converted(s, d, "p3"), _converted_sql("p3", lambda c: f"CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END")),
    "convert_prophoto": (lambda s, d: converted(s, d, "prophoto"), _converted_sql("prophoto", lambda c: f"CASE WHEN {c} <= 0.001953125 THEN {c} * 16 ELSE pow({c}, 1 / 1.8) END")),
    "gamut_clip": (gamut, pick("image_id, x, y, " + " AND ".join(f"({R[c]} - 0.5) * 1.3 + 0.5 BETWEEN 0 AND 1" for c in "rgb") + " AS fits, " + ", ".join(f"round(greatest(0, least(1, ({R[c]} - 0.5) * 1.3 + 0.5)) + 1e-9, 4) AS {c}" for c in "rgb"))),
    "delta_e2000": (delta_e2000, _CIE2000),
}
