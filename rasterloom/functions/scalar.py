"""The scalar function library, as Columns over doubles.

Expressions are written with these or in Spark's own SQL; there is no expression language beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def truthy(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & (F.abs(x) > 1e-12)


def clamp(x: Column, a: Column, b: Column) -> Column:
    """Bounds may come in either order."""
    return F.least(F.greatest(x, F.least(a, b)), F.greatest(a, b))


def smoothstep(a: Column, b: Column, x: Column) -> Column:
    """0 to 1 between a and b; with equal edges a step."""
    t = clamp((x - a) / F.when(a != b, b - a), F.lit(0.0), F.lit(1.0))
    return F.when(a == b, F.when(x < a, 0.0).otherwise(1.0)).otherwise(t * t * (3.0 - t * 2.0))


def checked(x: Column, ok: Column, what: str) -> Column:
    return F.when(ok, x).otherwise(F.raise_error(F.lit(what)).cast("double"))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "atan2": F.atan2,
    "asin": lambda x: F.asin(clamp(x, F.lit(-1.0), F.lit(1.0))), "acos": lambda x: F.acos(clamp(x, F.lit(-1.0), F.lit(1.0))),
    "deg": F.degrees, "rad": F.radians, "exp": F.exp, "abs": F.abs, "sign": F.signum, "hypot": F.hypot,
    "sqrt": lambda x: checked(F.sqrt(F.abs(x)), x >= 0, "square root of a negative number"),
    "pow": lambda x, y=None: F.pow(x, F.lit(0.0) if y is None else y),
    "log": lambda x: checked(F.ln(F.abs(x)), x > 0, "logarithm of a number that isn't positive"),
    "log2": lambda x: checked(F.log2(F.abs(x)), x > 0, "logarithm of a number that isn't positive"),
    "log10": lambda x: checked(F.log10(F.abs(x)), x > 0, "logarithm of a number that isn't positive"),
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": lambda x: F.round(x),
    "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), "fract": lambda x: x - F.floor(x),
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0], "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "sum": lambda *x: sum(x, F.lit(0.0)), "avg": lambda *x: sum(x, F.lit(0.0)) / max(1, len(x)),
    "clamp": clamp, "saturate": lambda x: clamp(x, F.lit(0.0), F.lit(1.0)),
    "lerp": lambda a, b, t: a + (b - a) * t, "mix": lambda a, b, t=None: a if t is None else a + (b - a) * t,
    "smoothstep": smoothstep, "step": lambda x, edge=None: F.when(x < (F.lit(0.0) if edge is None else edge), 0.0).otherwise(1.0),
    "isfinite": lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(1.0),
    "select": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
    "divide": lambda a, b: checked(a / F.when(F.abs(b) > 1e-12, b), F.abs(b) > 1e-12, "division by zero"),
    "modulo": lambda a, b: checked(a % F.when(F.abs(b) > 1e-12, b), F.abs(b) > 1e-12, "division by zero"),
    "equal": lambda a, b: F.when(F.abs(a - b) <= 1e-12, 1.0).otherwise(0.0),
}
#: Named constants.
CONSTANTS = {"pi": 3.141592653589793, "tau": 6.283185307179586, "e": 2.718281828459045, "sqrt2": 1.4142135623730951, "ln2": 0.6931471805599453}


def register(name: str, function: Callable[..., Column]) -> None:
    """Add a function of Columns, or replace one; it stays native."""
    FUNCTIONS[name] = function


def register_python(spark: SparkSession, name: str, function: Callable[..., float]) -> None:
    """Add a Python function of doubles for Spark SQL and Columns, run on Arrow batches."""
    spark.udf.register(name, F.udf(function, "double", useArrow=True))
    register(name, lambda *x: F.call_function(name, *x))
