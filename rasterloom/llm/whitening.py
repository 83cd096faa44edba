"""Whitening of vectors along their leading principal components, without ever forming the covariance matrix.

The components are eigenvectors of the covariance V of the distinct vectors.  Block Lanczos finds them from products
V times a few vectors alone: each product is one pass over the distinct vectors, in which a task centres its rows,
multiplies them with the block and by their own transpose, and gives one small matrix; Spark adds these up.  The driver
holds the basis (a column for each direction looked at), never a vector of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .vectors import exact_sums, integers, matrix

#: A component counts only if its share of the largest one's variance is over this; below lies rounding.
LEAST_SHARE = 1e-11
LONG = 2**63 - 1


def independent(block: np.ndarray, basis: np.ndarray, floor: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns for the block, orthogonal to the basis (orthogonalised against all of it, twice).

    A column of which no more than floor is left is a breakdown: a random direction takes its place.
    """
    room, found = basis.shape[1], basis
    for column in block.T[: len(basis) - room]:
        while True:
            size = np.linalg.norm(column)
            for _ in range(2):
                column = column - found @ (found.T @ column)
            left = np.linalg.norm(column)
            if left > max(floor, 1e-10 * size):
                break
            column, floor = rng.standard_normal(len(basis)), 0.0
        column = column / left
        column = column - found @ (found.T @ column)
        found = np.column_stack([found, column / np.linalg.norm(column)])
    return found[:, room:]


def leading(
    times: Callable[[np.ndarray], np.ndarray], width: int, count: int, block: int = 8, most: int = 512, tol: float = 1e-13, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues, falling, and eigenvectors (columns) of a symmetric width x width matrix.

    times(B) is the matrix times the columns of B.  Ends when each residual |A u - e u| is at most tol times the largest
    eigenvalue, or the basis spans everything.  A basis of more than `most` columns is replaced by the better half of its
    eigenvector estimates, with their products, which needs no pass.
    """
    rng = np.random.default_rng(seed)
    count, block = min(count, width), min(max(block, count), width)
    basis = products = np.zeros((width, 0))
    fresh = independent(rng.standard_normal((width, block)), basis, 0.0, rng)
    while True:
        last = times(fresh)
        basis, products = np.column_stack([basis, fresh]), np.column_stack([products, last])
        small = basis.T @ products
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors = basis @ turns[:, :count]
        left = np.linalg.norm(products @ turns[:, :count] - vectors * values[:count], axis=0)
        if basis.shape[1] == width or (left <= tol * abs(values[0])).all():
            return values[:count], vectors
        if basis.shape[1] + block > most:
            turns, values = turns[:, : max(block, most // 2)], values[: max(block, most // 2)]
            basis, products = basis @ turns, products @ turns
            last = (products - basis * values)[:, :block]
        fresh = independent(last, basis, tol * abs(values[0]), rng)


def summed(rows: DataFrame, width: int, columns: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(x), a matrix of `columns` columns, over the parts x of the table; a task gives one matrix."""
    names = [f"c{k}" for k in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(c, pa.float64()) for c in total.T)], ["i", *names])

    parts = rows.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return np.array([r[1:] for r in found], float).reshape(len(found), columns)


def exact_total(rows: DataFrame, width: int) -> list[int]:
    """The sum of each component over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            total = [a + b for a, b in zip(total, exact_sums(matrix(batch.column(0), width)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "s"])

    found = rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = [0] * width
    for i, s in found:
        total[i] = int(s)
    return total


@dataclass
class Whitening:
    """What fit() has found: n distinct vectors with component sums `total`, and components as columns."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total], float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2 for each row; None where that is no 64-bit number."""
        about = ((self.n * (x.astype(float) - self.mean)) ** 2).sum(axis=1)
        if np.abs(x).max(initial=0) * self.n < 2**61 and about.max(initial=0) < 2**62:
            return ((x * self.n - np.array(self.total, np.int64)) ** 2).sum(axis=1).tolist()
        out = []
        for row, size in zip(x.tolist(), about):
            exact = sum((self.n * v - s) ** 2 for v, s in zip(row, self.total)) if size < 2**64 else None
            out.append(exact if exact is not None and exact <= LONG else None)
        return out


def fit(rows: DataFrame, width: int, count: int = 4) -> Whitening | None:
    """Whitening of rows (x array<long>) by the covariance of the distinct ones; None for no rows."""
    distinct = keep(rows.select("x").distinct())
    n = distinct.count()
    if not n:
        return None
    found = Whitening(n, exact_total(distinct, width), np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
    mean = found.mean
    if not width:
        return found
    found.trace = float(summed(distinct, width, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    if found.trace <= 0:
        return found

    def times(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ block)

        return summed(distinct, width, block.shape[1], of) / n

    values, vectors = leading(times, width, count)
    some = values > LEAST_SHARE * values[0]
    vectors = vectors[:, some]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])  # one sign for all runs
    found.components, found.values = vectors, values[some]
    k = len(found.values)
    middle = summed(distinct, width, k, lambda x: found.whitened(x).sum(axis=0)[None, :])[0] / n

    def product(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x) - middle
        return w.T @ w

    found.identity_error = float(np.abs(summed(distinct, width, k, product) / n - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, count: int = 4, factor: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Components become x = floor(factor * component).  Vectors that are null or hold null or non-finite components are
    dropped; shorter vectors than the longest count as padded with zeros.  Repeated vectors count once in the fit and
    each get rows, as do repeated and null vec_ids.  Components without variance (all, if the vectors are equal) give no
    rows; equal eigenvalues share a space, of which some orthonormal basis is taken.  deviation is null where it exceeds a
    long.  Other columns are not read; an empty table gives no rows.
    """
    rows = integers(vectors, factor, "vec_id")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    found = fit(rows, width, count)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, explained = len(found.values), found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = matrix(batch.column(1), width), batch.num_rows
            of_row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(of_row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, found.n), pa.int64()), pa.array(found.deviations(x), pa.int64()).take(pa.array(of_row)),
                pa.array(found.whitened(x).reshape(-1), pa.float64()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, found.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
