"""Vectors compressed to one small code for each of their parts, by k-means in whole numbers with Hamerly's bounds.

Each vector is cut into equal parts, and each part position has a codebook of its own.  A round of Lloyd's method assigns
every part to the nearest entry and replaces entries by the mean of their parts.  With a part travel two bounds: `upper`
is at least the distance to its entry, `lower` at most the distance to every other one.  When entries move, upper grows
by its entry's move and lower shrinks by the largest move of another; only where upper isn't strictly less than lower (or
half the distance from its entry to the next one), even after upper has been measured, are all entries compared, in whole
numbers.  Strictly less means that no other entry is as near, so ties still go to the lower index.

Rounds write the table of parts, assignments and bounds to the shared folder and delete the one before; a second pass over
it adds up sums and counts for each entry, combined before the shuffle, of which the driver sees one row for each entry and
position.  Bounds are single precision, rounded away from the exact value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, table
from .vectors import integers, matrix

LONG = 2**63 - 1
#: A label with more than one row in HOT is joined by broadcast: there are less than HOT of them.
HOT = 256


def up(value: np.ndarray) -> np.ndarray:
    return np.nextafter(value.astype(np.float32), np.float32(np.inf))


def down(value: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(value.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Book:
    """The entries of one part position, and what they allow to say of distances."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries, k = entries, len(entries)
        between = root(((entries[:, None] - entries[None]) ** 2).sum(axis=2)).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = down(between.min(axis=1, initial=np.inf) / 2)
        moves = np.zeros(k, np.float32) if before is None else up(root(((entries - before) ** 2).sum(axis=1)))
        self.moves = np.where(moves <= np.finfo(np.float32).smallest_subnormal, np.float32(0), moves)
        others = np.where(np.eye(k, dtype=bool), np.float32(0), self.moves[None])
        self.others = others.max(axis=1, initial=0)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from each row of x to each entry."""
        return ((x[:, None] - self.entries[None]) ** 2).sum(axis=2)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry (lower index on ties) of each row, and its bounds."""
        far = self.squares(x)
        near, rows = far.argmin(axis=1), np.arange(len(x))
        upper = up(root(far[rows, near]))
        if far.shape[1] == 1:
            return near, upper, np.full(len(x), np.inf, np.float32)
        rest = far.astype(np.float64)
        rest[rows, near] = np.inf
        return near, upper, down(rest.min(axis=1) ** 0.5)

    def moved(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring assignments and bounds (changed in place) up to date; how many rows compared all entries."""
        upper[:] = np.where(self.moves[near] > 0, up(upper.astype(np.float64) + self.moves[near]), upper)
        lower[:] = np.where(self.others[near] > 0, down(lower.astype(np.float64) - self.others[near]), lower)
        least = np.maximum(lower, self.half[near])
        at = np.flatnonzero(~(upper < least))
        upper[at] = up(root(((x[at] - self.entries[near[at]]) ** 2).sum(axis=1)))
        at = at[~(upper[at] < least[at])]
        if len(at):
            near[at], upper[at], lower[at] = self.scan(x[at])
        return len(at)


def part_columns(width: int, parts: int) -> int:
    return -(-width // parts)


class Codes:
    """k-means over the parts of vectors (see the module); books: the entries of each part, as numpy matrices."""

    def __init__(self, rows: DataFrame, parts: int, entries: int, more: list[str]):
        self.rows, self.parts, self.more = rows, parts, more
        size, high = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.greatest(v.cast("decimal(20,0)"), -v.cast("decimal(20,0)")))))).first()
        self.columns = part_columns(size or 0, parts)
        # 64-bit numbers hold the squares; else Python's integers do, at their pace
        self.kind = np.int64 if 4 * int(high or 0) ** 2 * max(self.columns, 1) <= LONG else object
        self.summable = int(high or 0) < 2**20
        first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
        start = np.zeros((len(first), self.columns * parts), self.kind)
        for i, r in enumerate(first):
            start[i, : len(r["x"])] = r["x"]
        self.books = [Book(b) for b in np.split(start, parts, axis=1)]

    @property
    def split(self) -> Callable[[pa.Array], list[np.ndarray]]:
        """For tasks: the parts of a column of vectors, a matrix for each part position."""
        columns, parts, kind = self.columns, self.parts, self.kind
        return lambda column: np.split(matrix(column, columns * parts).astype(kind), parts, axis=1)

    def assigned(self, state: DataFrame | None) -> DataFrame:
        """x, near, upper, lower (one byte, and one single-precision number, for each part) and the columns `more`."""
        source = self.rows if state is None else state
        kinds = dict(self.rows.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*self.more, "x"]) + ", near binary, upper binary, lower binary"
        m, books, parts, split, fresh = len(self.more), self.books, self.parts, self.split, state is None
        names = [*self.more, "x", "near", "upper", "lower"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = split(batch.column(m))
                near, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
                if not fresh:
                    near, upper, lower = (unpacked(batch.column(m + 1 + i), k, n).copy() for i, k in enumerate((np.uint8, np.float32, np.float32)))
                for p, book in enumerate(books):
                    if fresh:
                        near[:, p], upper[:, p], lower[:, p] = book.scan(x[p])
                    else:
                        mine, u, w = near[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                        book.moved(x[p], mine, u, w)
                        near[:, p], upper[:, p], lower[:, p] = mine, u, w
                yield pa.RecordBatch.from_arrays([*batch.columns[: m + 1], *map(packed, (near, upper, lower))], names)

        return source.mapInArrow(run, schema)

    def update(self, state: DataFrame) -> None:
        """Replace each entry by floor(sum / count) of its parts; entries without parts stay."""
        books, parts, split, columns, quick = self.books, self.parts, self.split, self.columns, self.summable

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(books[0].entries)
            counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, columns), object)
            for batch in batches:
                near = unpacked(batch.column(1), np.uint8, batch.num_rows)
                for p, x in enumerate(split(batch.column(0))):
                    counts[p] += np.bincount(near[:, p], minlength=k)
                    if quick:  # whole numbers in double precision: exact below 2^53
                        for at in range(0, len(x), 1 << 20):
                            one = near[at : at + (1 << 20), p, None] == np.arange(k)
                            sums[p] += (one.astype(float).T @ x[at : at + (1 << 20)].astype(float)).astype(np.int64)
                    else:
                        np.add.at(sums[p], near[:, p], x.astype(object))
            rows = [(p, e, c, int(counts[p, e]), Decimal(int(sums[p, e, c]))) for p, e in zip(*np.nonzero(counts)) for c in range(columns)]
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["part", "entry", "place", "n", "s"])

        found = state.select("x", "near").mapInArrow(run, "part int, entry int, place int, n long, s decimal(38,0)")
        after = [b.entries.copy() for b in books]
        for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            after[r["part"]][r["entry"], r["place"]] = int(r["s"]) // r["n"]
        self.books = [Book(now, b.entries) for now, b in zip(after, books)]

    def rounds(self, count: int) -> DataFrame:
        """The state after `count` rounds and a last assignment."""
        state = keep(self.assigned(None))
        for _ in range(count):
            self.update(state)
            after = keep(self.assigned(state))
            forget(state)
            state = after
        return state

    def coded(self, state: DataFrame) -> DataFrame:
        """The columns `more`, code (hex digits) and error (exact, decimal(38,0)) of each row of the state."""
        kinds = dict(self.rows.dtypes)
        m, books, parts, split, names = len(self.more), self.books, self.parts, self.split, [*self.more, "code", "error"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = unpacked(batch.column(m + 1), np.uint8, batch.num_rows)
                error = np.zeros(batch.num_rows, object)
                for p, x in enumerate(split(batch.column(m))):
                    error = error + ((x - books[p].entries[near[:, p]]) ** 2).sum(axis=1).astype(object)
                code = pa.array([row.tobytes().hex() for row in near], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:m], code, pa.array(map(Decimal, map(int, error)), pa.decimal128(38, 0))], names)

        schema = "".join(f"`{c}` {kinds[c]}, " for c in self.more) + "code string, error decimal(38,0)"
        return state.select(*self.more, "x", "near").mapInArrow(run, schema)

    def digest(self) -> str:
        text = ",".join(str(int(v)) for b in self.books for v in b.entries.reshape(-1))
        return hashlib.sha256(text.encode()).hexdigest()


def packed(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = values.shape[1] * values.itemsize
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values)] if width else [b""] * len(values), pa.binary())


def unpacked(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def label_totals(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error: the error summed over the rows that share a label (null labels together).

    Sums are combined before the shuffle.  Labels that hold more than one row in HOT, less than HOT of them, are joined by
    broadcast, so no label's rows meet in one task; the rest by a shuffle.
    """
    sums = keep(coded.groupBy(F.col(label).alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    n = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(sums.filter(F.col("n") * HOT > n).select("of", "label_error", F.lit(True).alias("is_hot")))
    cold = sums.filter(F.col("n") * HOT <= n).select("of", "label_error")
    first = coded.join(hot, coded[label].eqNullSafe(hot["of"]), "left").drop("of")
    rest = first.filter("is_hot is null").drop("label_error", "is_hot")
    return first.filter("is_hot").drop("is_hot").unionByName(rest.join(cold, rest[label].eqNullSafe(cold["of"])).drop("of"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector without null or non-finite components.

    Components become floor(factor * component).  Codebooks start as the parts of the `entries` (at most 256) smallest
    vec_ids; of rows that share one, those with the smaller vectors come first, and null vec_ids after all others.  With
    fewer rows there are fewer entries.  Vectors shorter than the longest, or than a multiple of `parts`, count as padded
    with zeros.  Repeated rows each get their row; error and label_error are null where they exceed a long.  Columns
    other than vec_id, embedding and label are not read; an empty table gives no rows.
    """
    rows = integers(vectors, factor, "vec_id", "label")
    codes = Codes(rows, parts, entries, ["vec_id", "label"])
    coded = keep(codes.coded(codes.rounds(rounds)))
    long = lambda c: F.when(F.col(c) <= LONG, F.col(c)).cast("long").alias(c)
    return label_totals(coded).select("vec_id", "code", long("error"), long("label_error"), F.lit(codes.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> str:
    """Lloyd's method round by round: c holds codebooks, a assignments with all distances compared."""
    steps = [f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({factor} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k, x[k * (len(x) // {parts}) + 1 : (k + 1) * (len(x) // {parts})] AS z FROM v, unnest(range({parts})) AS u(k)),
c0 AS (SELECT k, rank - 1 AS e, z FROM (SELECT k, z, row_number() OVER (PARTITION BY k ORDER BY vec_id) AS rank FROM p) WHERE rank <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, k, any_value(z) AS z, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM
  (SELECT p.vec_id, p.label, p.k, p.z, c.e, list_sum(list_transform(list_zip(p.z, c.z), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM p JOIN c{r} c USING (k)) GROUP BY vec_id, k)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, e, i, sum(z[i])::BIGINT AS s, count(*) AS n FROM (SELECT k, e, z, unnest(range(1, len(z) + 1)) AS i FROM a{r}) GROUP BY k, e, i),
m{r} AS (SELECT k, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM s{r} GROUP BY k, e),
c{r + 1} AS MATERIALIZED (SELECT c.k, c.e, coalesce(m.z, c.z) AS z FROM c{r} c LEFT JOIN m{r} m USING (k, e))""")
    last = rounds
    return ",\n".join(steps) + f"""
, o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY k, e)) AS h FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, b"""


OP11_SQL = _sql()
