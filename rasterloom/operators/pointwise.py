"""Projections: each pixel of the result follows from one pixel of the image.  One narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..oracle import LUMA, byte as sql_byte, channels, f, pick
from ..sources.tables import KEY, SIDE, byte, f32, luma, pixels

#: Colour matrices, rows for r, g and b.
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
BLINDNESS = {
    "protanopia": ((0.56667, 0.43333, 0.0), (0.55833, 0.44167, 0.0), (0.0, 0.24167, 0.75833)),
    "deuteranopia": ((0.625, 0.375, 0.0), (0.7, 0.3, 0.0), (0.0, 0.3, 0.7)),
    "tritanopia": ((0.95, 0.05, 0.0), (0.0, 0.43333, 0.56667), (0.0, 0.475, 0.525)),
}
MATRIX = ((0.5, 0.25, 0.125, 0.0, 0.1), (0.125, 0.75, 0.0, 0.125, -0.05), (0.25, 0.25, 0.5, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 0.0))


def each(df: DataFrame, of) -> DataFrame:
    """of(channel) in place of r, g and b."""
    return df.withColumns({c: of(F.col(c)) for c in "rgb"})


def grayscale(df: DataFrame) -> DataFrame:
    return df.select(*KEY, byte(luma()).alias("v"))


def brightness_contrast(df: DataFrame, brightness: float, contrast: float) -> DataFrame:
    factor = f32(259) * (f32(contrast) + f32(255)) / (f32(255) * (f32(259) - f32(contrast)))
    return each(df, lambda c: byte(factor.cast("float") * (f32(c) + f32(brightness) - f32(128)) + f32(128)))


def gamma(df: DataFrame, value: float) -> DataFrame:
    if value <= 0:
        raise ValueError("gamma must be positive")
    lut = F.array(*[F.lit(int(min(255.0, max(0.0, (i / 255.0) ** (1.0 / value) * 255.0)))) for i in range(256)])
    return each(df, lambda c: F.get(lut, c))


def matrix(df: DataFrame, rows) -> DataFrame:
    """Rows of three weights for r, g and b."""
    old = [f32(F.col(c)) for c in "rgb"]
    return df.withColumns({c: byte(old[0] * f32(w[0]) + old[1] * f32(w[1]) + old[2] * f32(w[2])) for c, w in zip("rgb", rows)})


def color_matrix(df: DataFrame, rows=MATRIX) -> DataFrame:
    """Four rows of weights for r, g, b, a and an offset in units of 255."""
    old = [f32(F.col(c)) for c in "rgba"] + [f32(255)]
    total = lambda w: sum((f32(k) * v for k, v in zip(w[1:], old[1:])), f32(w[0]) * old[0])
    return df.withColumns({c: byte(total(w)) for c, w in zip("rgba", rows)})


def vignette(df: DataFrame, intensity: float, falloff: float, width: int = SIDE, height: int = SIDE) -> DataFrame:
    dx, dy = F.col("x") - width / 2, F.col("y") - height / 2
    dist = F.sqrt(dx * dx + dy * dy) / ((width / 2) ** 2 + (height / 2) ** 2) ** 0.5
    factor = F.least(F.greatest(1.0 - intensity * F.pow(dist, F.lit(falloff)), F.lit(0.0)), F.lit(1.0))
    return each(df, lambda c: F.floor(F.round(c * factor, 6)).cast("int"))


def vignette_ramp(df: DataFrame, radius: float, softness: float, width: int = SIDE, height: int = SIDE) -> DataFrame:
    dx, dy = F.col("x") - width / 2, F.col("y") - height / 2
    most = ((width / 2) ** 2 + (height / 2) ** 2) ** 0.5 * radius
    inner = most * (1 - softness)
    ramp = F.least(F.greatest((F.sqrt(dx * dx + dy * dy) - inner) / (most * softness), F.lit(0.0)), F.lit(1.0))
    return each(df, lambda c: F.floor(F.round(c * (1.0 - ramp), 6)).cast("int"))


def solarize(df: DataFrame, threshold: int) -> DataFrame:
    return each(df, lambda c: F.when(c > threshold, 255 - c).otherwise(c))


def posterize(df: DataFrame, levels: int) -> DataFrame:
    if not 2 <= levels <= 256:
        raise ValueError("levels must be 2 to 256")
    step = f32(255) / f32(levels - 1)
    return each(df, lambda c: byte(F.round((f32(c) / step.cast("float")).cast("float")).cast("float") * step.cast("float")))


def thermal(df: DataFrame) -> DataFrame:
    """Blue, cyan, yellow, red by luma."""
    val = (luma() / f32(255)).cast("float")
    part = lambda low: ((val - f32(low)) * f32(4)).cast("float")
    zero, one = f32(0), f32(1)
    ramp = lambda a, b, c, d: F.when(val < f32(0.25), a).when(val < f32(0.5), b).when(val < f32(0.75), c).otherwise(d)
    ramps = {"r": ramp(zero, zero, part(0.5), one), "g": ramp(zero, part(0.25), one, one - part(0.75)), "b": ramp(part(0), one, one - part(0.5), part(0.75))}
    return df.withColumns({c: byte((v * f32(255)).cast("float")) for c, v in ramps.items()})


def threshold(df: DataFrame, level: int) -> DataFrame:
    return df.select(*KEY, F.when(byte(luma()) >= level, 255).otherwise(0).alias("v"))


def premultiply(df: DataFrame) -> DataFrame:
    return each(df, lambda c: F.floor((c * F.col("a") + 127) / 255).cast("int"))


def unpremultiply(df: DataFrame) -> DataFrame:
    return each(df, lambda c: F.when(F.col("a") == 0, 0).otherwise(F.least(F.lit(255), F.floor((c * 255 + F.floor(F.col("a") / 2)) / F.greatest("a", F.lit(1))))).cast("int"))


def fill_alpha(df: DataFrame, value: int) -> DataFrame:
    return df.withColumn("a", F.lit(value))


def extract_alpha(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.col("a").alias("v"))


def stretch(df: DataFrame) -> DataFrame:
    """All channels of an image together to 0..255; a constant image stays.  One small aggregate for each image."""
    spans = df.groupBy("image_id").agg(F.min(F.least("r", "g", "b")).alias("lo"), F.max(F.greatest("r", "g", "b")).alias("hi"))
    joined = df.join(spans, "image_id")
    new = lambda c: F.when(F.col("hi") == F.col("lo"), c).otherwise(byte(((f32(c) - f32(F.col("lo"))) * f32(255) / (f32(F.col("hi")) - f32(F.col("lo")))).cast("float")))
    return each(joined, new).drop("lo", "hi")


def cube_lookup(df: DataFrame, lut: DataFrame) -> DataFrame:
    """Colours by a 256 x 16 table of (lx, ly, r, g, b); its 4,096 rows are broadcast."""
    at = df.withColumns({"lx": F.expr("cast((b div 16) * 16 + r div 16 as int)"), "ly": F.expr("cast(g div 16 as int)")})
    return at.drop("r", "g", "b").join(F.broadcast(lut), ["lx", "ly"]).drop("lx", "ly")


def inverted_cube(spark) -> DataFrame:
    """A look-up table that inverts colours to 16 levels."""
    return spark.range(4096).selectExpr(
        "cast(id % 256 as int) lx", "cast(id div 256 as int) ly",
        "cast(255 - (id % 16) * 17 as int) r", "cast(255 - (id div 256) * 17 as int) g", "cast(255 - ((id % 256) div 16) * 17 as int) b")


def halftone_channels(df: DataFrame) -> DataFrame:
    """The four ink shares of a pixel, as screens use them."""
    most = F.greatest("r", "g", "b")
    k = (255 - most) / 255.0
    ink = lambda c: F.when(most == 0, 0.0).otherwise((most - F.col(c)) / most)
    return df.select(*KEY, *[F.round(v, 4).alias(n) for n, v in (("c", ink("r")), ("m", ink("g")), ("yl", ink("b")), ("k", k))])


def _sql_matrix(rows) -> str:
    names = dict(zip("rgb", rows))
    return channels(lambda c: sql_byte(" + ".join(f"{f(x)} * {f(w)}" for x, w in zip("rgb", names[c]))))


def _sql_round(value: str) -> str:
    return f"CAST(floor(round({value}, 6)) AS INTEGER)"


_MOST = "greatest(r, g, b)"
_K = f"((255 - {_MOST}) / CAST(255 AS DOUBLE))"
_INK = lambda c: f"round(CASE WHEN {_MOST} = 0 THEN 0 ELSE CAST({_MOST} - {c} AS DOUBLE) / {_MOST} END, 4)"
_V = f"({LUMA} / {f(255)})"
_PART = lambda low: f"(({_V} - {f(low)}) * {f(4)})"
_RAMP = lambda a, b, c, d: f"CASE WHEN {_V} < {f(0.25)} THEN {a} WHEN {_V} < {f(0.5)} THEN {b} WHEN {_V} < {f(0.75)} THEN {c} ELSE {d} END"
_THERMAL = {
    "r": _RAMP(f(0), f(0), _PART(0.5), f(1)), "g": _RAMP(f(0), _PART(0.25), f(1), f"({f(1)} - {_PART(0.75)})"),
    "b": _RAMP(_PART(0), f(1), f"({f(1)} - {_PART(0.5)})", _PART(0.75)),
}
_FACTOR = f"({f(259)} * ({f(30)} + {f(255)}) / ({f(255)} * ({f(259)} - {f(30)})))"
_DIST = "sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0))"

OPS = {
    "grayscale": (lambda s, d: grayscale(pixels(s, d)), pick(f"image_id, x, y, {sql_byte(LUMA)} AS v")),
    "brightness_contrast": (
        lambda s, d: brightness_contrast(pixels(s, d), 20, 30),
        channels(lambda c: sql_byte(f"{_FACTOR} * ({f(c)} + {f(20)} - {f(128)}) + {f(128)}"))),
    "gamma_correction": (
        lambda s, d: gamma(pixels(s, d), 2.2),
        channels(lambda c: f"CAST(trunc(least(255.0, greatest(0.0, pow({c} / CAST(255 AS DOUBLE), CAST(1 AS DOUBLE) / CAST(2.2 AS DOUBLE)) * 255))) AS INTEGER)")),
    "sepia": (lambda s, d: matrix(pixels(s, d), SEPIA), _sql_matrix(SEPIA)),
    **{f"color_blindness_{k}": (lambda s, d, m=m: matrix(pixels(s, d), m), _sql_matrix(m)) for k, m in BLINDNESS.items()},
    "color_matrix": (
        lambda s, d: color_matrix(pixels(s, d)),
        pick("image_id, x, y, " + ", ".join(
            sql_byte(" + ".join(f"{f(w)} * {v}" for w, v in zip(row, [f("r"), f("g"), f("b"), f("a"), f(255)]))) + f" AS {c}" for c, row in zip("rgba", MATRIX)))),
    "vignette": (
        lambda s, d: vignette(pixels(s, d), 0.8, 2.0),
        channels(lambda c: _sql_round(f"{c} * least(1.0, greatest(0.0, 1.0 - CAST(0.8 AS DOUBLE) * pow({_DIST} / sqrt(CAST(32 AS DOUBLE)), 2.0)))"))),
    "vignette_ramp": (
        lambda s, d: vignette_ramp(pixels(s, d), 0.75, 0.5),
        channels(lambda c: _sql_round(f"{c} * (1.0 - least(1.0, greatest(0.0, ({_DIST} - sqrt(CAST(32 AS DOUBLE)) * 0.375) / (sqrt(CAST(32 AS DOUBLE)) * 0.375))))"))),
    "solarize": (lambda s, d: solarize(pixels(s, d), 128), channels(lambda c: f"CASE WHEN {c} > 128 THEN 255 - {c} ELSE {c} END")),
    "posterize": (
        lambda s, d: posterize(pixels(s, d), 4),
        channels(lambda c: sql_byte(f"CAST(round({f(c)} / ({f(255)} / {f(3)})) AS FLOAT) * ({f(255)} / {f(3)})"))),
    "thermal": (lambda s, d: thermal(pixels(s, d)), channels(lambda c: sql_byte(f"({_THERMAL[c]}) * {f(255)}"))),
    "threshold": (lambda s, d: threshold(pixels(s, d), 120), pick(f"image_id, x, y, CASE WHEN {sql_byte(LUMA)} >= 120 THEN 255 ELSE 0 END AS v")),
    "premultiply_alpha": (lambda s, d: premultiply(pixels(s, d)), channels(lambda c: f"CAST(({c} * a + 127) // 255 AS INTEGER)")),
    "unpremultiply_alpha": (
        lambda s, d: unpremultiply(pixels(s, d)),
        channels(lambda c: f"CAST(CASE WHEN a = 0 THEN 0 ELSE least(255, ({c} * 255 + a // 2) // greatest(a, 1)) END AS INTEGER)")),
    "fill_alpha": (lambda s, d: fill_alpha(pixels(s, d), 200), channels(lambda c: c, "CAST(200 AS INTEGER) AS a")),
    "extract_alpha": (lambda s, d: extract_alpha(pixels(s, d)), pick("image_id, x, y, a AS v")),
    "stretch": (
        lambda s, d: stretch(pixels(s, d)),
        pick("px.image_id, x, y, " + ", ".join(
            f"CASE WHEN hi = lo THEN {c} ELSE {sql_byte(f'({f(c)} - {f('lo')}) * {f(255)} / ({f('hi')} - {f('lo')})')} END AS {c}" for c in "rgb") + ", a",
            "px JOIN sp USING (image_id)", ", sp AS (SELECT image_id, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM px GROUP BY image_id)")),
    "cube_lookup": (
        lambda s, d: cube_lookup(pixels(s, d), inverted_cube(s)),
        pick("image_id, x, y, a, CAST(255 - (r // 16) * 17 AS INTEGER) AS r, CAST(255 - (g // 16) * 17 AS INTEGER) AS g, CAST(255 - (b // 16) * 17 AS INTEGER) AS b")),
    "ink_shares": (
        lambda s, d: halftone_channels(pixels(s, d)),
        pick(f"image_id, x, y, {_INK('r')} AS c, {_INK('g')} AS m, {_INK('b')} AS yl, round({_K}, 4) AS k")),
}
