"""Blending two pixels: modes, and Porter-Duff source over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(mode: str, base: Column, top: Column) -> Column:
    """One channel (0..1) of a separable mode; an unknown mode is normal."""
    one, two = F.lit(1.0), F.lit(2.0)
    hard = lambda by: F.when(by < 0.5, two * base * top).otherwise(one - two * (one - base) * (one - top))
    curve = lambda: F.when(base <= 0.25, ((16.0 * base - 12.0) * base + 4.0) * base).otherwise(F.sqrt(base))
    of = {
        "multiply": lambda: base * top, "screen": lambda: one - (one - base) * (one - top), "overlay": lambda: hard(base),
        "darken": lambda: F.least(base, top), "lighten": lambda: F.greatest(base, top),
        "color_dodge": lambda: F.when(base <= 0, 0.0).when(top >= 1, 1.0).otherwise(F.least(one, base / F.when(top < 1, one - top))),
        "color_burn": lambda: F.when(base >= 1, 1.0).when(top <= 0, 0.0).otherwise(one - F.least(one, (one - base) / F.when(top > 0, top))),
        "hard_light": lambda: hard(top),
        "soft_light": lambda: F.when(top <= 0.5, base - (one - two * top) * base * (one - base)).otherwise(base + (two * top - one) * (curve() - base)),
        "difference": lambda: F.abs(base - top), "exclusion": lambda: base + top - two * base * top,
    }.get(mode, lambda: top)
    return of()


MODES = ("normal", "multiply", "screen", "overlay", "darken", "lighten", "color_dodge", "color_burn", "hard_light", "soft_light", "difference", "exclusion")
WHOLE = ("hue", "saturation", "color", "luminosity")


def luminosity(c: dict[str, Column]) -> Column:
    return 0.2126 * c["r"] + 0.7152 * c["g"] + 0.0722 * c["b"]


def bound(c: dict[str, Column], body) -> Column:
    """body(c) with the channels of c evaluated once."""
    return F.get(F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in c.items()])), lambda s: body({k: s[k] for k in c})), F.lit(0))


def packed(c: dict[str, Column]) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in c.items()])


def set_luminosity(c: dict[str, Column], to: Column) -> Column:
    """Shifted to a luminosity, and drawn towards it where a channel leaves 0..1: a struct."""
    shift = to - luminosity(c)

    def clipped(c: dict[str, Column]) -> Column:
        lum, low, high = luminosity(c), F.least(*c.values()), F.greatest(*c.values())

        def clip(v: Column) -> Column:
            up = F.when(low < 0, F.when(lum - low > 1e-7, lum + (v - lum) * lum / (lum - low)).otherwise(lum)).otherwise(v)
            return F.when(high > 1, F.when(high - lum > 1e-7, lum + (up - lum) * (1.0 - lum) / (high - lum)).otherwise(lum)).otherwise(up)

        return packed({k: clip(v) for k, v in c.items()})

    return bound({k: v + shift for k, v in c.items()}, clipped)


def set_saturation(c: dict[str, Column], to: Column) -> dict[str, Column]:
    low, high = F.least(*c.values()), F.greatest(*c.values())
    return {k: F.when(high > low, (v - low) * to / (high - low)).otherwise(0.0) for k, v in c.items()}


def saturation(c: dict[str, Column]) -> Column:
    return F.greatest(*c.values()) - F.least(*c.values())


def whole(mode: str, base: dict[str, Column], top: dict[str, Column]) -> Column:
    """The modes that take hue, saturation and luminosity apart: a struct of r, g, b."""
    if mode == "hue":
        return bound(set_saturation(top, saturation(base)), lambda c: set_luminosity(c, luminosity(base)))
    if mode == "saturation":
        return bound(set_saturation(base, saturation(top)), lambda c: set_luminosity(c, luminosity(base)))
    if mode == "color":
        return set_luminosity(top, luminosity(base))
    return set_luminosity(base, luminosity(top))


def any_mode(mode: Column, below: dict[str, Column], above: dict[str, Column]) -> Column:
    """A struct of r, g, b by a mode that each row names; an unknown or null one is normal."""
    mixed = F.when(F.lit(False), packed(above))
    for m in (*MODES[1:], *WHOLE):
        mixed = mixed.when(mode == m, whole(m, below, above) if m in WHOLE else packed({k: channel(m, below[k], above[k]) for k in "rgb"}))
    return mixed.otherwise(packed(above))


def over(mode: str | Column, base: dict[str, Column], top: dict[str, Column], opacity: float | Column) -> Column:
    """A struct of bytes r, g, b, a: top over base.  Where top has no alpha, or opacity is 0, base stays."""
    unit = lambda c: {k: c[k] / 255.0 for k in "rgb"}
    below, above = unit(base), unit(top)
    if isinstance(mode, Column):
        mixed = any_mode(mode, below, above)
    else:
        mixed = whole(mode, below, above) if mode in WHOLE else packed({k: channel(mode, below[k], above[k]) for k in "rgb"})
    ab, at = base["a"] / 255.0, top["a"] / 255.0 * opacity
    ao = at + ab * (1.0 - at)
    byte = lambda v: F.floor(F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5, 6)).cast("int")

    def out(mixed: dict[str, Column]) -> Column:
        parts = {k: (at * mixed[k] + ab * below[k] * (1.0 - at)) / ao for k in "rgb"} | {"a": ao}
        return F.struct(*[F.when(at <= 0, base[k]).otherwise(byte(v)).cast("int").alias(k) for k, v in parts.items()])

    return F.get(F.transform(F.array(mixed), lambda s: out({k: s[k] for k in "rgb"})), F.lit(0))


def over_whole_numbers(base: dict[str, Column], top: dict[str, Column], opacity: int) -> dict[str, Column]:
    """Straight-alpha over in whole numbers."""
    div = lambda a, b: F.floor(a / b).cast("int")
    at = div(top["a"] * opacity + 127, F.lit(255))
    wb = div(base["a"] * (255 - at) + 127, F.lit(255))
    ao = at + wb
    mixed = {k: F.when(ao == 0, 0).otherwise(div(top[k] * at + base[k] * wb + div(ao, F.lit(2)), F.greatest(ao, F.lit(1)))) for k in "rgb"} | {"a": F.least(ao, F.lit(255))}
    return {k: F.when(at == 0, base[k]).when(at == 255, top[k]).otherwise(v) for k, v in mixed.items()}
