"""Vectors of a table as integers in Spark, and as numpy matrices inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components; false for the rest and for null vectors."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def integers(vectors: DataFrame, factor: int, *more: str, vector: str = "embedding") -> DataFrame:
    """The columns `more`, and x array<long>: floor(factor * component) of each vector that finite() accepts."""
    x = F.transform(vector, lambda e: F.floor(e.cast("double") * factor))
    return vectors.filter(finite(F.col(vector))).select(*more, x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of 64-bit integers, padded on the right with zeros up to width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    x = np.zeros((len(sizes), width), np.int64)
    x[np.arange(width) < sizes[:, None]] = flat
    return x


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers; high and low halves are summed apart, so none overflows."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low)]
