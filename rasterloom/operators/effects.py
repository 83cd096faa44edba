"""Effects over whole images: tiles equalised with clipped histograms, look-up cubes, shadows, halftone screens, mirrors.

An image is a row with an array for each channel.  Some images of one size are stacked inside Arrow batches, and each step is
taken once for the whole stack; nothing is shuffled, and an image must fit into a task.  Arithmetic is single precision,
step by step, where whole results hang on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..oracle import LUMA, PX, byte as sql_byte, f
from ..sources.tables import images, pixels, stacks

F4 = np.float32
SCHEMA = "image_id long, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>"


def whole_images(s, d) -> DataFrame:
    """image_id, width, height, r, g, b, a of the table's images; their pixels are those of sources.tables.pixels."""
    turn = lambda k: F.concat(F.slice("v", k + 1, 64), F.slice("v", 1, k))
    alpha = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * 37 % 256).cast("int"))
    return images(s, d).select("image_id", "width", "height", F.col("v").alias("r"), turn(21).alias("g"), turn(42).alias("b"), alpha.alias("a"))


def over_stacks(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """of(stack) for stacks (image, y, x, channel) of r, g, b, a; the new images may have another size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, h, some in stacks(parts):
            stack = np.stack([np.stack(some[c].to_list()) for c in "rgba"], -1).reshape(len(some), h, w, 4)
            out = of(stack.astype(np.int64)).astype(np.int32)
            planes = {c: list(out[..., k].reshape(len(out), -1)) for k, c in enumerate("rgba")}
            yield pd.DataFrame({"image_id": some["image_id"].to_list(), "width": out.shape[2], "height": out.shape[1]} | planes)

    return df.select("image_id", "width", "height", *"rgba").mapInPandas(run, SCHEMA)


def spread(df: DataFrame) -> DataFrame:
    """A row for each pixel: image_id, x, y, r, g, b, a."""
    return df.select("image_id", "width", F.posexplode(F.arrays_zip(*"rgba")).alias("i", "c")).select(
        "image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[f"c.{c}" for c in "rgba"])


def bytes_of(value: np.ndarray) -> np.ndarray:
    return np.trunc(value.clip(0, 255))


def hsl(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in turns, saturation and lightness of r, g, b."""
    r, g, b = (stack[..., k].astype(F4) / F4(255) for k in range(3))
    most, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    light, d = (most + least) / F4(2), most - least
    some = d > 0
    safe = np.where(some, d, F4(1))
    s = np.where(light > F4(0.5), d / np.where(some, F4(2) - most - least, F4(1)), d / np.where(some, most + least, F4(1)))
    h = np.where(most == r, (g - b) / safe + np.where(g < b, F4(6), F4(0)), np.where(most == g, (b - r) / safe + F4(2), (r - g) / safe + F4(4)))
    return np.where(some, h / F4(6), F4(0)) * F4(360), np.where(some, s, F4(0)), light


def from_hsl(h: np.ndarray, s: np.ndarray, light: np.ndarray) -> list[np.ndarray]:
    h = h / F4(360)
    q = np.where(light < F4(0.5), light * (F4(1) + s), light + s - light * s)
    p = F4(2) * light - q
    third = F4(1) / F4(3)

    def channel(t: np.ndarray) -> np.ndarray:
        t = np.where(t < 0, t + F4(1), t)
        t = np.where(t > 1, t - F4(1), t)
        up, down = p + (q - p) * F4(6) * t, p + (q - p) * (F4(2) / F4(3) - t) * F4(6)
        return np.where(t < F4(1) / F4(6), up, np.where(t < F4(0.5), q, np.where(t < F4(2) / F4(3), down, p)))

    return [bytes_of(np.where(s == 0, light, channel(t)) * F4(255)) for t in (h + third, h, h - third)]


def tile_equalized(grid: int, clip: float) -> Callable[[np.ndarray], np.ndarray]:
    """Lightness by the cumulative histograms of the four nearest of grid x grid tiles, between which it is interpolated.

    Histograms are clipped at `clip` times an even share (0: not), and what is over is dealt to all bins, without its rest.
    Rows and columns beyond the last whole tile count in no histogram; images smaller than the grid stay.
    """

    def of(stack: np.ndarray) -> np.ndarray:
        n, h, w, _ = stack.shape
        tw, th = w // grid, h // grid
        if not tw or not th:
            return stack
        hue, s, light = hsl(stack)
        level = np.trunc(light * F4(255)).astype(np.int64)
        tile = (np.arange(th * grid) // th)[:, None] * grid + np.arange(tw * grid) // tw
        owner = np.arange(n)[:, None, None] * grid * grid + tile
        counts = np.bincount((owner * 256 + level[:, : th * grid, : tw * grid]).ravel(), minlength=n * grid * grid * 256).reshape(-1, 256)
        if clip > 0:
            limit = int(F4(clip) * F4(tw * th) / F4(256))
            counts = np.minimum(counts, limit) + (np.maximum(counts - limit, 0).sum(1) // 256)[:, None]
        share = (counts.cumsum(1).astype(F4) / F4(tw * th)).reshape(n, grid * grid, 256)

        def near(size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = (np.arange(size, dtype=F4) - F4(step / 2)) / F4(step)
            low = np.floor(at)
            return low.astype(int).clip(0, grid - 1), (low.astype(int) + 1).clip(0, grid - 1), at - low

        (x0, x1, fx), (y0, y1, fy) = near(w, tw), near(h, th)
        fy = fy[:, None]
        k = np.arange(n)[:, None, None]
        at = lambda y, x: share[k, y[:, None] * grid + x, level]
        one = F4(1)
        new = (one - fx) * (one - fy) * at(y0, x0) + fx * (one - fy) * at(y0, x1) + (one - fx) * fy * at(y1, x0) + fx * fy * at(y1, x1)
        return np.stack([*from_hsl(hue, s, new.clip(0, 1)), np.full(level.shape, 255)], -1)

    return of


#: The most entries along a side of a cube that is sent to tasks: 65 cubed colours are under a megabyte.
MOST_ENTRIES = 65


def cube_of(lut: DataFrame, size: int) -> np.ndarray:
    """A cube (blue, green, red, channel) of a table of place, r, g, b, place = red + green * size + blue * size * size."""
    if not 2 <= size <= MOST_ENTRIES:
        raise ValueError(f"cubes have 2 to {MOST_ENTRIES} entries along a side")
    rows = lut.select("place", "r", "g", "b").limit(size**3 + 1).collect()
    if len(rows) != size**3 or {r["place"] for r in rows} != set(range(size**3)):
        raise ValueError(f"a cube of side {size} needs places 0 to {size ** 3 - 1}, once each")
    return np.array([r[1:] for r in sorted(rows)]).reshape(size, size, size, 3)


def through_cube(cube: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Colours between the eight nearest entries of a cube, first along red, then green, then blue; alpha stays."""

    def of(stack: np.ndarray) -> np.ndarray:
        most = len(cube) - 1
        at = stack[..., :3].astype(F4) / F4(255) * F4(most)
        low = np.floor(at).astype(int)
        high, share = np.minimum(low + 1, most), (at - low.astype(F4))[..., None]
        entry = lambda r, g, b: cube[b[..., 2], g[..., 1], r[..., 0]].astype(F4)
        mix = lambda one, two, k: one * (F4(1) - share[..., k, :]) + two * share[..., k, :]
        along_red = {(g, b): mix(entry(low, gs, bs), entry(high, gs, bs), 0) for g, gs in enumerate((low, high)) for b, bs in enumerate((low, high))}
        along_green = [mix(along_red[0, b], along_red[1, b], 1) for b in (0, 1)]
        return np.concatenate([bytes_of(mix(*along_green, 2)), stack[..., 3:]], -1)

    return of


def shadowed(dx: int, dy: int, blur: float, opacity: float, colour: tuple[int, int, int] = (0, 0, 0)) -> Callable[[np.ndarray], np.ndarray]:
    """A wider image on its shadow: the alpha in one colour, moved by dx and dy, box-blurred across and down."""

    def blurred(v: np.ndarray, axis: int, radius: int) -> np.ndarray:
        size = v.shape[axis]
        total = np.concatenate([np.zeros_like(v.take([0], axis)), v.cumsum(axis)], axis)
        lo, hi = (np.arange(size) - radius).clip(0), (np.arange(size) + radius + 1).clip(max=size)
        shape = [-1 if k == axis else 1 for k in range(v.ndim)]
        return (total.take(hi, axis) - total.take(lo, axis)) // (hi - lo).reshape(shape)

    def of(stack: np.ndarray) -> np.ndarray:
        n, h, w, _ = stack.shape
        pad = max(0, ceil(blur * 3))
        out = np.zeros((n, h + abs(dy) + pad * 2, w + abs(dx) + pad * 2, 4), np.int64)
        x, y = pad + max(0, -dx), pad + max(0, -dy)
        shade = out[:, y + dy : y + dy + h, x + dx : x + dx + w]
        shade[..., :3] = colour
        shade[..., 3] = np.trunc(stack[..., 3].astype(F4) / F4(255) * F4(opacity) * F4(255))
        if blur > 0.5:
            out = blurred(blurred(out, 2, int(blur)), 1, int(blur))
        under = out[:, y : y + h, x : x + w]
        top, below = stack[..., 3:].astype(F4) / F4(255), under[..., 3:].astype(F4) / F4(255)
        alpha = top + below * (F4(1) - top)
        safe = np.where(alpha > 0, alpha, F4(1))
        mixed = (stack[..., :3].astype(F4) * top + under[..., :3].astype(F4) * below * (F4(1) - top)) / safe
        out[:, y : y + h, x : x + w] = np.where(alpha > 0, np.trunc(np.concatenate([mixed, alpha * F4(255)], -1)), 0)
        return out

    return of


def screened(pattern: str, size: int, angle: float) -> Callable[[np.ndarray], np.ndarray]:
    """Black dots, lines or crosses on white, larger where the mean luma of a cell of size x size is darker; nothing in cells under a twentieth.

    Alpha is 255 but where ink stands, where it stays.
    """
    c, s = F4(cos(F4(angle * pi / 180))), F4(sin(F4(angle * pi / 180)))

    def of(stack: np.ndarray) -> np.ndarray:
        n, h, w, _ = stack.shape
        gray = np.trunc(F4(0.299) * stack[..., 0].astype(F4) + F4(0.587) * stack[..., 1].astype(F4) + F4(0.114) * stack[..., 2].astype(F4))
        rows, columns = np.arange(0, h, size), np.arange(0, w, size)
        sums = np.add.reduceat(np.add.reduceat(gray.astype(np.int64), rows, 1), columns, 2)
        count = np.minimum(size, h - rows)[:, None] * np.minimum(size, w - columns)
        dark = F4(1) - sums.astype(F4) / count.astype(F4) / F4(255)
        dark = dark.repeat(size, 1)[:, :h].repeat(size, 2)[:, :, :w]
        off = lambda m: (np.arange(m) - np.arange(m) // size * size).astype(F4) - F4(size / 2)
        x, y = off(w)[None, :], off(h)[:, None]
        rx, ry = x * c - y * s, x * s + y * c
        if pattern == "dot":
            ink = np.sqrt(rx * rx + ry * ry) <= F4(size / 2) * dark
        else:
            reach = F4(size / 4) * dark
            ink = np.abs(ry) <= reach
            if pattern == "cross":
                ink |= np.abs(rx) <= reach
        ink &= dark > F4(0.05)
        out = np.where(ink, 0, 255)
        return np.stack([out, out, out, np.where(ink, stack[..., 3], 255)], -1)

    return of


def mirrored(count: int) -> Callable[[np.ndarray], np.ndarray]:
    """The sector from the centre to the right, mirrored and turned to all `count` sectors."""

    def of(stack: np.ndarray) -> np.ndarray:
        _, h, w, _ = stack.shape
        y, x = np.mgrid[:h, :w]
        dx, dy = x - w / 2, y - h / 2
        sector = 2 * pi / count
        turn = np.arctan2(dy, dx).round(9) % sector
        turn = np.where(turn > sector / 2, sector - turn, turn)
        radius = np.sqrt(dx * dx + dy * dy)
        at = lambda half, of, most: np.trunc((half + radius * of(turn)).round(6)).astype(int).clip(0, most - 1)
        return stack[:, at(h / 2, np.sin, h), at(w / 2, np.cos, w)]

    return of


CUBE = 5


def colour_cube(s, d) -> DataFrame:
    """A look-up cube of the first pixels of the table's images."""
    place = F.col("image_id") * 64 + F.col("y") * 8 + F.col("x")
    return pixels(s, d).select(place.alias("place"), "r", "g", "b").filter(F.col("place") < CUBE**3)


_HSL = f"""hs AS (SELECT *, greatest(fr, fg, fb) AS mx, least(fr, fg, fb) AS mn FROM (SELECT px.*, {f('r')} / {f(255)} AS fr, {f('g')} / {f(255)} AS fg, {f('b')} / {f(255)} AS fb FROM px)),
hl AS (SELECT *, (mx + mn) / {f(2)} AS l, mx - mn AS dd FROM hs),
hu AS (SELECT *, CASE WHEN dd > 0 THEN CASE WHEN l > {f(0.5)} THEN dd / ({f(2)} - mx - mn) ELSE dd / (mx + mn) END ELSE {f(0)} END AS s,
  CASE WHEN dd > 0 THEN CASE WHEN mx = fr THEN (fg - fb) / dd + CASE WHEN fg < fb THEN {f(6)} ELSE {f(0)} END WHEN mx = fg THEN (fb - fr) / dd + {f(2)} ELSE (fr - fg) / dd + {f(4)} END / {f(6)} ELSE {f(0)} END * {f(360)} / {f(360)} AS h,
  CAST(trunc(l * {f(255)}) AS INTEGER) AS lv FROM hl)"""


def _sql_channel(t: str) -> str:
    t1 = f"(CASE WHEN {t} < 0 THEN {t} + {f(1)} ELSE {t} END)"
    t2 = f"(CASE WHEN {t1} > 1 THEN {t1} - {f(1)} ELSE {t1} END)"
    sixth, two = f"{f(1)} / {f(6)}", f"{f(2)} / {f(3)}"
    return f"CASE WHEN s = 0 THEN nl WHEN {t2} < {sixth} THEN p + (q - p) * {f(6)} * {t2} WHEN {t2} < {f(0.5)} THEN q WHEN {t2} < {two} THEN p + (q - p) * ({two} - {t2}) * {f(6)} ELSE p END"


def _tiles_sql(grid: int, clip: float) -> str:
    step = 8 // grid
    limit = int(clip * step * step / 256)
    at = lambda c: f"({f(c)} - {f(step / 2)}) / {f(step)}"
    ahead = lambda c: f"greatest(0, least({grid - 1}, CAST(floor({at(c)}) AS INTEGER)))", lambda c: f"greatest(0, least({grid - 1}, CAST(floor({at(c)}) AS INTEGER) + 1))"
    lo, hi = ahead
    part = lambda c: f"({at(c)} - floor({at(c)}))"
    join = " ".join(f"JOIN cd c{j}{i} ON c{j}{i}.image_id = hu.image_id AND c{j}{i}.tx = {(lo, hi)[i]('x')} AND c{j}{i}.ty = {(lo, hi)[j]('y')} AND c{j}{i}.bin = hu.lv" for j in (0, 1) for i in (0, 1))
    fx, fy, one = part("x"), part("y"), f(1)
    new = f"({one} - {fx}) * ({one} - {fy}) * c00.c + {fx} * ({one} - {fy}) * c01.c + ({one} - {fx}) * {fy} * c10.c + {fx} * {fy} * c11.c"
    third = f"{f(1)} / {f(3)}"
    out = ", ".join(f"{sql_byte('(' + _sql_channel(t) + ') * ' + f(255))} AS {c}" for c, t in zip("rgb", (f"(h + {third})", "h", f"(h - {third})")))
    return f"""{PX}, {_HSL},
ti AS (SELECT image_id, x // {step} AS tx, y // {step} AS ty, lv AS bin, count(*) AS n FROM hu GROUP BY ALL),
al AS (SELECT image_id, tx, ty, CAST(bin AS INTEGER) AS bin FROM (SELECT DISTINCT image_id, tx, ty FROM ti), unnest(range(256)) AS u(bin)),
fu AS (SELECT al.*, coalesce(n, 0) AS n FROM al LEFT JOIN ti USING (image_id, tx, ty, bin)),
cl AS (SELECT image_id, tx, ty, bin, least(n, {limit}) + sum(greatest(n - {limit}, 0)) OVER (PARTITION BY image_id, tx, ty) // 256 AS n FROM fu),
cd AS (SELECT image_id, tx, ty, bin, CAST(sum(n) OVER (PARTITION BY image_id, tx, ty ORDER BY bin) AS FLOAT) / {f(step * step)} AS c FROM cl),
ne AS (SELECT hu.image_id, hu.x, hu.y, h, s, greatest({f(0)}, least({f(1)}, {new})) AS nl FROM hu {join}),
qq AS (SELECT *, CASE WHEN nl < {f(0.5)} THEN nl * ({f(1)} + s) ELSE nl + s - nl * s END AS q FROM ne), pp AS (SELECT *, {f(2)} * nl - q AS p FROM qq)
SELECT image_id, x, y, {out}, 255 AS a FROM pp"""


def _cube_sql() -> str:
    at = lambda c: f"({f(c)} / {f(255)} * {f(CUBE - 1)})"
    low = lambda c: f"CAST(floor({at(c)}) AS INTEGER)"
    ends = {c: (low(c), f"least({low(c)} + 1, {CUBE - 1})") for c in "rgb"}
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    joins = " ".join(f"JOIN lu l{i}{j}{k} ON l{i}{j}{k}.place = {ends['r'][i]} + {CUBE} * {ends['g'][j]} + {CUBE * CUBE} * {ends['b'][k]}" for i, j, k in corners)
    part = {c: f"({at(c)} - {f(low(c))})" for c in "rgb"}
    mix = lambda one, two, c: f"({one} * ({f(1)} - {part[c]}) + {two} * {part[c]})"
    entry = lambda i, j, k, c: f(f"l{i}{j}{k}.{c}")
    of = lambda c: mix(*[mix(*[mix(entry(0, j, k, c), entry(1, j, k, c), "r") for j in (0, 1)], "g") for k in (0, 1)], "b")
    own = lambda text: text.replace("CAST(r AS", "CAST(p.r AS").replace("CAST(g AS", "CAST(p.g AS").replace("CAST(b AS", "CAST(p.b AS")
    return own(f"{PX}, lu AS (SELECT image_id * 64 + y * 8 + x AS place, r, g, b FROM px WHERE image_id * 64 + y * 8 + x < {CUBE ** 3}) SELECT p.image_id, p.x, p.y, " + ", ".join(f"{sql_byte(of(c))} AS {c}" for c in "rgb") + f", p.a FROM px p {joins}")


SHADOW = {"dx": 2, "dy": -3, "blur": 1.2, "opacity": 0.6, "colour": (10, 20, 30)}


def _shadow_sql(dx: int, dy: int, blur: float, opacity: float, colour: tuple) -> str:
    pad, radius = ceil(blur * 3), int(blur)
    w, h, x, y = 8 + abs(dx) + pad * 2, 8 + abs(dy) + pad * 2, pad + max(0, -dx), pad + max(0, -dy)
    shade = ", ".join(f"CASE WHEN px.a IS NULL THEN 0 ELSE {v} END AS {c}" for c, v in zip("rgb", colour)) + f", CASE WHEN px.a IS NULL THEN 0 ELSE CAST(trunc({f('px.a')} / {f(255)} * {f(opacity)} * {f(255)}) AS INTEGER) END AS a"
    blurred = lambda source, along, other: f"SELECT image_id, x, y, " + ", ".join(f"sum({c}) OVER s // count(*) OVER s AS {c}" for c in "rgba") + f" FROM {source} WINDOW s AS (PARTITION BY image_id, {other} ORDER BY {along} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    top, below = f"({f('p.a')} / {f(255)})", f"({f('v.a')} / {f(255)})"
    alpha = f"({top} + {below} * ({f(1)} - {top}))"
    mixed = lambda c: f"CAST(trunc(({f('p.' + c)} * {top} + {f('v.' + c)} * {below} * ({f(1)} - {top})) / {alpha}) AS INTEGER)"
    out = lambda c, e: f"CAST(CASE WHEN p.a IS NULL THEN v.{c} WHEN {alpha} > 0 THEN {e} ELSE 0 END AS INTEGER) AS {c}"
    return f"""{PX}, ca AS (SELECT vec_id AS image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM embeddings, unnest(range({w})) AS a(x), unnest(range({h})) AS b(y)),
sh AS (SELECT ca.*, {shade} FROM ca LEFT JOIN px ON px.image_id = ca.image_id AND px.x = ca.x - {x + dx} AND px.y = ca.y - {y + dy}),
b1 AS ({blurred('sh', 'x', 'y')}), b2 AS ({blurred('b1', 'y', 'x')})
SELECT v.image_id, v.x, v.y, {', '.join(out(c, mixed(c)) for c in 'rgb')}, {out('a', f'CAST(trunc({alpha} * {f(255)}) AS INTEGER)')} FROM b2 v LEFT JOIN px p ON p.image_id = v.image_id AND p.x = v.x - {x} AND p.y = v.y - {y}"""


def _screen_sql(pattern: str, size: int, angle: float) -> str:
    c, s = f(float(F4(cos(F4(angle * pi / 180))))), f(float(F4(sin(F4(angle * pi / 180)))))
    rx, ry = f"(ox * {c} - oy * {s})", f"(ox * {s} + oy * {c})"
    reach = f"{f(size / 4)} * dark"
    ink = {"dot": f"CAST(sqrt({rx} * {rx} + {ry} * {ry}) AS FLOAT) <= {f(size / 2)} * dark", "line": f"abs({ry}) <= {reach}", "cross": f"(abs({ry}) <= {reach} OR abs({rx}) <= {reach})"}[pattern]
    return f"""{PX}, ce AS (SELECT *, {sql_byte(LUMA)} AS l, {f(f'x % {size}')} - {f(size / 2)} AS ox, {f(f'y % {size}')} - {f(size / 2)} AS oy FROM px),
da AS (SELECT *, {f(1)} - {f('sum(l) OVER w')} / {f('count(*) OVER w')} / {f(255)} AS dark FROM ce WINDOW w AS (PARTITION BY image_id, x // {size}, y // {size})),
ik AS (SELECT *, dark > {f(0.05)} AND {ink} AS ink FROM da)
SELECT image_id, x, y, CASE WHEN ink THEN 0 ELSE 255 END AS r, CASE WHEN ink THEN 0 ELSE 255 END AS g, CASE WHEN ink THEN 0 ELSE 255 END AS b, CASE WHEN ink THEN a ELSE 255 END AS a FROM ik"""


def _mirror_sql(count: int) -> str:
    sector = 2 * pi / count
    return f"""{PX}, po AS (SELECT image_id, x, y, sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0)) AS radius, round(atan2(y - 4.0, x - 4.0), 9) AS t FROM px),
tu AS (SELECT *, t - floor(t / {sector}) * {sector} AS m FROM po), mi AS (SELECT *, CASE WHEN m > {sector / 2} THEN {sector} - m ELSE m END AS k FROM tu),
pl AS (SELECT image_id, x, y, greatest(0, least(7, CAST(trunc(round(4 + radius * cos(k), 6)) AS INTEGER))) AS sx, greatest(0, least(7, CAST(trunc(round(4 + radius * sin(k), 6)) AS INTEGER))) AS sy FROM mi)
SELECT pl.image_id, pl.x, pl.y, px.r, px.g, px.b, px.a FROM pl JOIN px ON px.image_id = pl.image_id AND px.x = sx AND px.y = sy"""


def _op(of):
    return lambda s, d: spread(over_stacks(whole_images(s, d), of))


OPS = {
    "tile_equalize": (_op(tile_equalized(2, 40.0)), _tiles_sql(2, 40.0)),
    "tile_equalize_unclipped": (_op(tile_equalized(4, 1e6)), _tiles_sql(4, 1e6)),
    "cube_trilinear": (lambda s, d: spread(over_stacks(whole_images(s, d), through_cube(cube_of(colour_cube(s, d), CUBE)))), _cube_sql()),
    "drop_shadow": (_op(shadowed(**SHADOW)), _shadow_sql(**SHADOW)),
    "drop_shadow_hard": (_op(shadowed(-1, 2, 0.0, 0.5)), _shadow_sql(-1, 2, 0.0, 0.5, (0, 0, 0))),
    "halftone_dots": (_op(screened("dot", 4, 30.0)), _screen_sql("dot", 4, 30.0)),
    "halftone_lines": (_op(screened("line", 3, 45.0)), _screen_sql("line", 3, 45.0)),
    "halftone_crosses": (_op(screened("cross", 5, 15.0)), _screen_sql("cross", 5, 15.0)),
    "kaleidoscope": (_op(mirrored(6)), _mirror_sql(6)),
}
