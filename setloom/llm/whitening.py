"""Whitening of embeddings from an exact integer scatter.

An entry c becomes the whole number x = floor(64 c) + 1000000. Tasks subtract a shift (one row's x, so that what is left is
small), append a one to every vector, and add up the products of all pairs of entries: with the one, these hold the number
of vectors and the sums too. Products are exact: a block of rows goes through floating-point matrix products only while
every sum in it stays below 2^53, otherwise through Python's integers. A task's sums leave it once, as digits to the base
2^32, so that Spark adds them as longs without overflow, however many tasks there are. From the digits the driver forms
n XᵀX - SSᵀ in whole numbers of any size, which does not depend on the shift, and only then converts to floats and
decomposes by ``eigh``. What reaches the driver is of the dimension squared, never of the rows.

Rows are then projected: n x - S is exact too, and is converted after the subtraction. The covariance of what was projected
is measured over all rows, by means and centred products that are merged pairwise, and compared with the identity.

Defined results: rows whose vector is null, empty, or has a null or non-finite entry are dropped. All others count, repeated
rows and ids each on their own; a null id is kept. Vectors of different lengths are an error. There are at most 32
components, and only those whose variance can be told from zero (above dimension times 2^-52 of the largest), so a table of
one vector, or of equal ones, has none and gives no rows, as an empty one does. Of each component's two signs, the one
whose entry of largest size is positive is taken. ``deviation`` is null where it is no 64-bit number; ``deviation_exact``
then has its digits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .vectors import EXACT, entries, floors, kept_vectors, magnitude

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows of one floating-point product; entries below SMALL then sum to less than 2^53.
ROWS = 1 << 13
SMALL = 1 << 20
_DIGIT = 32
#: Groups of tasks whose covariances are merged on the way to the driver.
_GROUPS = 256


def shifted(c: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x minus the shift, which is of Python's integers; 64-bit integers where they do."""
    x = floors(c, SCALE)
    if x.dtype != object and magnitude(shift) < EXACT:
        return x + (OFFSET - shift.astype(np.int64))
    return x.astype(object) + OFFSET - shift


def products(y: np.ndarray) -> np.ndarray:
    """yᵀy in Python's integers. Rows with large entries are multiplied as such, apart from the others."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    large = (y >= SMALL).any(axis=1) | (y <= -SMALL).any(axis=1)
    few = y[~large].astype(np.float64)
    for at in range(0, len(few), ROWS):
        block = few[at : at + ROWS]
        out += (block.T @ block).astype(np.int64).astype(object)
    if large.any():
        rest = y[large].astype(object)
        out += rest.T.dot(rest)
    return out


def digits(value: int) -> list[int]:
    """Digits to the base 2^32, lowest first; the highest has the sign."""
    out = []
    while not -(1 << _DIGIT) < value < 1 << _DIGIT:
        out.append(value & ((1 << _DIGIT) - 1))
        value >>= _DIGIT
    return [*out, value]


def scatter(vectors: DataFrame, shift: list[int]) -> np.ndarray:
    """The sums of products of all pairs of shifted entries, and of ones: a matrix of Python's integers, one larger each way
    than the dimension."""
    size, by = len(shift), np.array(shift, object)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), object)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = shifted(entries(b.column(0).slice(at, ROWS), size), by)
                total += products(np.hstack([y, np.ones((len(y), 1), y.dtype)]))
        rows = [(i, j, k, d) for i in range(size + 1) for j in range(i, size + 1) for k, d in enumerate(digits(total[i, j])) if d]
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "place", "digit"])

    parts = vectors.select("embedding").mapInArrow(each, "i int, j int, place int, digit long")
    out = np.zeros((size + 1, size + 1), object)
    for r in parts.groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).collect():  # of the dimension squared
        out[r.i, r.j] += r.digit << (_DIGIT * r.place)
    return np.triu(out) + np.triu(out, 1).T


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors: x is shifted by ``shift``; n, sums of shifted x; components as columns, falling."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    half: int  # floats hold the scatter divided by 4^half
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def deviations(self, y: np.ndarray) -> list[int]:
        """The sum of (n x - S)^2 of each row, from sums of squares and products that are small."""
        size, large = y.shape[1], magnitude(y)
        if y.dtype != object and size * large * max(large, magnitude(self.sums)) < 1 << 62:
            squares, mixed = (y * y).sum(axis=1), y @ self.sums.astype(np.int64)
        else:
            z = y.astype(object)
            squares, mixed = (z * z).sum(axis=1), z.dot(self.sums)
        total, n = int((self.sums * self.sums).sum()), self.n
        return [n * n * q - 2 * n * m + total for q, m in zip(squares.tolist(), mixed.tolist(), strict=True)]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """n x - S exactly, then projected: the divisions by n and by the root of n squared cancel."""
        if y.dtype != object and self.n * magnitude(y) + magnitude(self.sums) < EXACT:
            d = (y * self.n - self.sums.astype(np.int64)).astype(np.float64) / 2.0**self.half
        else:
            d = _as_floats(y.astype(object) * self.n - self.sums, self.half)
        return d @ self.directions / np.sqrt(self.eigenvalues)


def _as_floats(values: np.ndarray, half: int, times: int = 1) -> np.ndarray:
    """Whole numbers divided by 2^(half * times), rounded once."""
    by = 1 << (half * times)
    return np.array([v / by for v in values.ravel().tolist()], np.float64).reshape(values.shape)


def decomposed(sums_of_products: np.ndarray, shift: list[int], most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a scatter; None if there are no vectors."""
    n, sums, size = int(sums_of_products[-1, -1]), sums_of_products[:-1, -1], len(shift)
    if n == 0:
        return None
    exact = n * sums_of_products[:-1, :-1] - np.outer(sums, sums)
    half = max(0, (max(int(exact[i, i]).bit_length() for i in range(size)) - 900) // 2)
    matrix = _as_floats(exact, half, 2)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(int(exact[i, i]) for i in range(size)) / (1 << (2 * half))
    count = int((values[:most] > max(values[0], 0.0) * size * 2.0**-52).sum()) if trace > 0 else 0
    values, vectors = values[:count], vectors[:, :count]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)]) if count else np.ones(0)
    return Whitening(n, np.array(shift, object), sums, half, vectors * signs, values, values / trace if count else values)


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of all ``vectors`` (embedding)."""
    first = vectors.select("embedding").first()
    if first is None:
        return None
    c = np.array([[float(x) for x in first.embedding]])
    shift = [int(x) + OFFSET for x in floors(c, SCALE)[0].tolist()]
    return decomposed(scatter(vectors, shift), shift)


def _merge(a: tuple, b: tuple) -> tuple:
    """Number, means and centred products of two sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def covariance(vectors: DataFrame, by: Whitening) -> np.ndarray:
    """The covariance of the whitened rows, divisor n; every product is of centred values."""
    size, k = len(by.shift), len(by.eigenvalues)
    schema = StructType([StructField("group", IntegerType()), StructField("task", IntegerType()), StructField("n", LongType()), StructField("state", BinaryType())])

    def packed(group: int, task: int, state: tuple) -> dict:
        return {"group": [group], "task": [task], "n": [state[0]], "state": [np.concatenate([state[1], state[2].ravel()]).tobytes()]}

    def unpacked(n: int, data: bytes) -> tuple:
        flat = np.frombuffer(data, np.float64)
        return n, flat[:k], flat[k:].reshape(k, k)

    none = (0, np.zeros(k), np.zeros((k, k)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = none
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                w = by.whitened(shifted(entries(b.column(0).slice(at, ROWS), size), by.shift))
                mean = w.mean(axis=0)
                state = _merge(state, (len(w), mean, (w - mean).T @ (w - mean)))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(packed(task % _GROUPS, task, state), pa.schema([("group", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("state", pa.binary())]))

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state = rows.sort_values("task"), none  # in one order, so that reruns agree
        for n, data in zip(rows["n"], rows["state"], strict=True):
            state = _merge(state, unpacked(int(n), data))
        return pd.DataFrame(packed(int(rows["group"].iloc[0]), 0, state))

    parts = vectors.select("embedding").mapInArrow(each, schema).groupBy("group").applyInPandas(merged, schema)
    state = none
    for r in sorted(parts.collect(), key=lambda r: r.group):  # at most _GROUPS
        state = _merge(state, unpacked(r.n, r.state))
    return state[2] / max(1, state[0])


def whiten(table: DataFrame) -> DataFrame:
    """For each vector and component: vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error."""
    vectors = kept_vectors(table, "vec_id")
    fields = [table.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("deviation_exact", StringType())]
    schema = StructType([*fields, *[StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    by = fit(vectors)
    k = len(by.eigenvalues) if by else 0
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    error, size = float(np.abs(covariance(vectors, by) - np.eye(k)).max()), len(by.shift)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                y = shifted(entries(part.column(1), size), by.shift)
                n, exact = len(y), by.deviations(y)
                held = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
                beyond = pa.array([None if x < 1 << 63 else str(x) for x in exact], pa.string())
                row = pa.array(np.repeat(np.arange(n), k))
                columns = [part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, by.n)), held.take(row), beyond.take(row)]
                columns += [pa.array(by.whitened(y).ravel()), pa.array(np.tile(by.explained, n)), pa.array(np.full(n * k, error))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.mapInArrow(each, schema)
