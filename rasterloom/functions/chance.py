"""Values of linear generators by place, with 64-bit wrap-around on Columns.

A generator steps by state = state * A + C modulo 2^64.  k steps together are a step of the same kind, so the state after k
steps is found by jumping: for each bit of k that is set, by the multiplier and constant of so many steps.  A row's
value hangs on its place alone, not on the rows before it, so rows can be anywhere.
Numbers of 64 bits are four limbs of 16 bits, whose products fit a long with room to spare.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and constant of the generator, and its state before the first step.
MULTIPLIER, CONSTANT, START = 6364136223846793005, 1442695040888963407, 12345678901234
MASK = (1 << 64) - 1
#: Steps that can be jumped: places below 2 to this power.
BITS = 48


def limbs(value: int) -> tuple[int, ...]:
    return tuple(value >> 16 * i & 0xFFFF for i in range(4))


def jumps(multiplier: int, constant: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Multiplier and constant of 1, 2, 4, ... steps."""
    out = []
    for _ in range(bits):
        out.append((multiplier, constant))
        multiplier, constant = multiplier * multiplier & MASK, constant * (multiplier + 1) & MASK
    return out


def shifted(k: Column, bit: Column) -> Column:
    return F.call_function("shiftright", k, bit)


def state_after(k: Column, start: int = START, multiplier: int = MULTIPLIER, constant: int = CONSTANT) -> Column:
    """The state after k steps (0 to 2^48 - 1) as a struct of limbs s0 (lowest) to s3."""
    named = lambda values: F.struct(*[(F.lit(v).cast("long") if isinstance(v, int) else v).alias(f"s{i}") for i, v in enumerate(values)])
    steps = F.array(*[F.struct(F.lit(i).alias("bit"), named(limbs(m)).alias("m"), named(limbs(c)).alias("c")) for i, (m, c) in enumerate(jumps(multiplier, constant))])
    part = lambda s, i: s[f"s{i}"]

    def step(s: Column, j: Column) -> Column:
        columns = [sum((part(s, a) * part(j["m"], i - a) for a in range(i + 1)), part(j["c"], i)) for i in range(4)]
        carried = F.lit(0).cast("long")
        out = []
        for column in columns:
            total = column + carried
            out.append(total.bitwiseAND(F.lit(0xFFFF)))
            carried = F.shiftright(total, 16)
        return F.when(shifted(k, j["bit"]).bitwiseAND(F.lit(1)) == 1, named(out)).otherwise(s)

    return F.aggregate(steps, named(limbs(start)), step)


def rand(k: Column, start: int = START) -> Column:
    """The k-th value (from 1 on) in [0, 1): the upper 53 bits of the state; null for null and for places out of range."""
    whole = k.cast("long")
    bound = F.get(F.transform(F.array(state_after(whole, start)), lambda s: F.shiftleft(s["s3"], 37) + F.shiftleft(s["s2"], 21) + F.shiftleft(s["s1"], 5) + F.shiftright(s["s0"], 11)), F.lit(0))
    return F.when((whole >= 1) & (whole < 1 << BITS), bound / float(1 << 53))
