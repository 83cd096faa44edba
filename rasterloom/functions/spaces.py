"""RGB spaces: transfer curves, matrices from primaries and white points, and conversions between spaces.

Curves and conversions are expressions on Columns; matrices are 3 x 3 tuples worked out while a plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import EPSILON, KAPPA, unit

Matrix = tuple[tuple[float, float, float], ...]
Of = Callable[[Column], Column]

#: White points and primaries (CIE xy), and the constants of the published curves.
WHITES = {"D50": (0.3457, 0.3585), "D55": (0.3324, 0.3474), "D65": (0.3127, 0.3290), "A": (0.4476, 0.4074), "E": (0.3333, 0.3333)}
PQ = {"m1": 2610 / 16384, "m2": 2523 / 4096 * 128, "c1": 3424 / 4096, "c2": 2413 / 4096 * 32, "c3": 2392 / 4096 * 32}
HLG = {"a": 0.17883277, "b": 0.28466892, "c": 0.55991073}
CONES = {
    "bradford": ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296)),
    "von_kries": ((0.40024, 0.70760, -0.08081), (-0.22630, 1.16532, 0.04570), (0.0, 0.0, 0.91822)),
    "scaling": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
}


def inside(curve: Of) -> Of:
    """The curve between 0 and 1; 0 below and 1 above."""
    return lambda v: F.when(v <= 0, 0.0).when(v >= 1, 1.0).otherwise(curve(v))


def power(gamma: float) -> tuple[Of, Of]:
    return inside(lambda v: F.pow(v, F.lit(gamma))), inside(lambda v: F.pow(v, F.lit(1 / gamma)))


def pq_linear(v: Column) -> Column:
    p = F.pow(v, F.lit(1 / PQ["m2"]))
    return F.pow(F.greatest(p - PQ["c1"], F.lit(0.0)) / (PQ["c2"] - p * PQ["c3"]), F.lit(1 / PQ["m1"]))


def pq_encoded(v: Column) -> Column:
    p = F.pow(v, F.lit(PQ["m1"]))
    return F.pow((p * PQ["c2"] + PQ["c1"]) / (p * PQ["c3"] + 1), F.lit(PQ["m2"]))


#: Each curve as (to linear light, from linear light).
CURVES: dict[str, tuple[Of, Of]] = {
    "linear": (lambda v: v, lambda v: v),
    "srgb": (
        inside(lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))),
        inside(lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)),
    ),
    "gamma22": power(2.2),
    "gamma28": power(2.8),
    "adobe": power(563 / 256),
    "prophoto": (
        inside(lambda v: F.when(v <= 16 / 512, v / 16).otherwise(F.pow(v, F.lit(1.8)))),
        inside(lambda v: F.when(v <= 1 / 512, v * 16).otherwise(F.pow(v, F.lit(1 / 1.8)))),
    ),
    "pq": (inside(pq_linear), inside(pq_encoded)),
    "hlg": (
        inside(lambda v: F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12)),
        inside(lambda v: F.when(v <= 1 / 12, F.sqrt(v * 3)).otherwise(F.log(v * 12 - HLG["b"]) * HLG["a"] + HLG["c"])),
    ),
}


def lookup(curve: Of, points: int = 4096) -> Column:
    """The curve at evenly spaced points from 0 to 1, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: curve(i / float(points - 1)))


def looked_up(table: Column, v: Column, points: int = 4096) -> Column:
    """The value of a lookup table at v (0 to 1), linear between its points."""
    at = unit(v) * float(points - 1)
    low = F.least(F.floor(at).cast("int"), F.lit(points - 2))
    return F.get(table, low) + (F.get(table, low + 1) - F.get(table, low)) * (at - low)


class Space(NamedTuple):
    primaries: tuple[tuple[float, float], ...]
    white: str
    curve: str


#: Primaries of red, green and blue.
SPACES = {
    "srgb": Space(((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "D65", "srgb"),
    "linear": Space(((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "D65", "linear"),
    "adobe": Space(((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)), "D65", "adobe"),
    "prophoto": Space(((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001)), "D50", "prophoto"),
    "p3": Space(((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)), "D65", "srgb"),
}


def multiplied(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def transposed(a: Matrix) -> Matrix:
    return tuple(zip(*a))


def applied(a: Matrix, v) -> tuple:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in a)


def determinant(a: Matrix) -> float:
    return sum(a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3))


def inverse(a: Matrix) -> Matrix:
    """The inverse; of a singular matrix, the identity."""
    d = determinant(a)
    if abs(d) < 1e-12:
        return ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    cofactor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    return tuple(tuple(cofactor(j, i) / d for j in range(3)) for i in range(3))


def white_xyz(name: str) -> tuple[float, float, float]:
    x, y = WHITES[name]
    return x / y, 1.0, (1 - x - y) / y


def to_xyz(space: str) -> Matrix:
    """The matrix from linear RGB to XYZ, under the space's own white."""
    columns = transposed(tuple((x / y, 1.0, (1 - x - y) / y) for x, y in SPACES[space].primaries))
    scale = applied(inverse(columns), white_xyz(SPACES[space].white))
    return tuple(tuple(v * s for v, s in zip(row, scale)) for row in columns)


def adaptation(source: str, target: str, cones: str = "bradford") -> Matrix:
    """The matrix that takes XYZ under one white to another."""
    m = CONES[cones]
    ratio = [t / s for s, t in zip(applied(m, white_xyz(source)), applied(m, white_xyz(target)))]
    return multiplied(inverse(m), tuple(tuple(v * r for v in row) for row, r in zip(m, ratio)))


def between(source: str, target: str, cones: str = "bradford") -> Matrix:
    """The matrix from linear RGB of one space to that of another."""
    adapted = multiplied(adaptation(SPACES[source].white, SPACES[target].white, cones), to_xyz(source))
    return multiplied(inverse(to_xyz(target)), adapted)


def converted(rgb: list[Column], source: str, target: str, cones: str = "bradford") -> list[Column]:
    """Colours of one space in another: linear light, matrix, and the target's curve; of one and the same space, as they are."""
    if source == target:
        return list(rgb)
    line = [CURVES[SPACES[source].curve][0](v) for v in rgb]
    if (SPACES[source].primaries, SPACES[source].white) != (SPACES[target].primaries, SPACES[target].white):
        line = list(applied(between(source, target, cones), line))
    return [CURVES[SPACES[target].curve][1](v) for v in line]


def in_gamut(rgb: list[Column]) -> Column:
    return rgb[0].between(0, 1) & rgb[1].between(0, 1) & rgb[2].between(0, 1)


def lab_to_linear(light: Column, a: Column, b: Column, space: str = "srgb") -> list[Column]:
    """CIE Lab (of the space's white) in linear RGB of the space, which may lie outside of 0 to 1."""
    fy = (light + 16) / 116
    bent = lambda f: F.when(f * f * f > EPSILON, f * f * f).otherwise((f * 116 - 16) / KAPPA)
    white = white_xyz(SPACES[space].white)
    y = F.when(light > KAPPA * EPSILON, fy * fy * fy).otherwise(light / KAPPA)
    return list(applied(inverse(to_xyz(space)), (bent(fy + a / 500) * white[0], y * white[1], bent(fy - b / 200) * white[2])))


def into_gamut(light: Column, a: Column, b: Column, space: str = "srgb", rounds: int = 32) -> Column:
    """The colour (struct of r, g, b) of this lightness and hue with as much of its chroma as the space holds, encoded."""
    bounds = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def step(x: Column, _: Column) -> Column:
        middle = (x["low"] + x["high"]) / 2
        fits = in_gamut(lab_to_linear(light, a * middle, b * middle, space))
        return F.struct(F.when(fits, middle).otherwise(x["low"]).alias("low"), F.when(fits, x["high"]).otherwise(middle).alias("high"))

    share = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), bounds, step)["low"]
    encode = CURVES[SPACES[space].curve][1]
    # bound by a lambda, so that the bisection is done once
    rgb = F.transform(F.array(share), lambda s: F.struct(*[encode(v).alias(c) for c, v in zip("rgb", lab_to_linear(light, a * s, b * s, space))]))
    return F.get(rgb, F.lit(0))
