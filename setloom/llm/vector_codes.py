"""Vectors as short codes: product quantisation in whole numbers.

A component x becomes floor(256 x); a vector is cut into equal parts, and each part position has a codebook of its own. Its
first entries are that part of the vectors of smallest id. A round assigns every part to the nearest entry (ties to the
lower index) and replaces each entry by the componentwise floor of its parts' mean; entries without parts stay.

The kept vectors are written once as columnar blocks: of some thousand vectors, all first components, then all second ones,
and so on. A round is a ``treeAggregate`` over the blocks: in a block, distances accumulate dimension by dimension, from one
contiguous column each; ``np.add.at`` adds the block's parts into a tensor of sums (parts, entries, components) and one of
counts, and tensors are merged through a reduction tree, so no node gets more than a few. The size of a tensor is that of
the codebooks, whatever the number of rows. All sums are of whole numbers, so neither the order of blocks nor a task that
runs again changes a digit. Integers have 64 bits while their size proves that no distance or sum can overflow, which is
checked, and are Python's otherwise.

Defined results: rows whose vector is null, empty, or has a null or non-finite component are dropped. Repeated rows and ids
count each on their own. Of equal ids the vector that sorts first by its components goes first; null ids are last. With
fewer vectors than entries, there are as many entries as vectors. Lengths that differ, or that the parts don't divide, are
an error. A null label is a label. An error beyond 64 bits is null, as is its label's sum. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .joins import salted_join
from .store import settle
from .vectors import entries, floors, kept_vectors, magnitude

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block.
BLOCK = 4096
_SAFE = 1 << 62


def blocks_of(vectors: DataFrame, size: int) -> DataFrame:
    """(rows, data): blocks of vectors, a column after another, as floats; these hold what integers are made from."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                column = b.column(0).slice(at, BLOCK)
                values = entries(column, size)
                kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
                data = np.ascontiguousarray(values.T.astype(kind)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([data], pa.binary())], ["rows", "width", "data"])

    return vectors.select("embedding").mapInArrow(each, StructType([StructField("rows", IntegerType()), StructField("width", IntegerType()), StructField("data", BinaryType())]))


def components(data: bytes, width: int, rows: int) -> np.ndarray:
    """A block's whole numbers, a row a component."""
    return floors(np.frombuffer(data, f"<f{width}").reshape(-1, rows).astype(np.float64), SCALE)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector: the index of the nearest entry, and the squared distance. ``books`` has (part, entry, component)."""
    parts, size, length = books.shape
    rows = block.shape[1]
    if block.dtype != object and books.dtype != object and length * (magnitude(block) + magnitude(books)) ** 2 < _SAFE:
        kind = np.int64
    else:
        kind, block, books = object, block.astype(object), books.astype(object)
    index, least = np.empty((parts, rows), np.int64), np.empty((parts, rows), kind)
    for p in range(parts):
        distance = np.zeros((size, rows), kind)
        for j in range(length):
            gap = block[p * length + j] - books[p, :, j, None]
            distance += gap * gap
        index[p] = distance.argmin(axis=0)  # the first of equal ones
        least[p] = distance[index[p], np.arange(rows)]
    return index, least


def added(state: tuple, block: np.ndarray, books: np.ndarray) -> tuple:
    """Sums and counts with those of a block's parts."""
    sums, counts = state
    parts, _, length = books.shape
    index, _ = nearest(block, books)
    if block.dtype == object or magnitude(block) * block.shape[1] + magnitude(sums) >= _SAFE:
        sums = sums.astype(object)
    for p in range(parts):
        for j in range(length):
            np.add.at(sums[p, :, j], index[p], block[p * length + j])
        np.add.at(counts[p], index[p], 1)
    return sums, counts


def merged(a: tuple, b: tuple) -> tuple:
    """The sums and counts of two states, in Python's integers where 64 bits might not hold them."""
    if object in (a[0].dtype, b[0].dtype) or magnitude(a[0]) + magnitude(b[0]) >= _SAFE:
        return a[0].astype(object) + b[0].astype(object), a[1] + b[1]
    return a[0] + b[0], a[1] + b[1]


def first_books(vectors: DataFrame, parts: int, size: int) -> np.ndarray | None:
    """The parts of the vectors of smallest id: (part, entry, component), of Python's integers. None if there are no vectors."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), F.col("embedding")).limit(size).collect()  # at most ``size``
    if not rows:
        return None
    lengths = sorted({len(r.embedding) for r in rows})
    if len(lengths) > 1 or lengths[0] % parts:
        raise ValueError(f"vectors of {', '.join(map(str, lengths))} components can't be cut into {parts} equal parts")
    values = floors(np.array([[float(x) for x in r.embedding] for r in rows]), SCALE)
    return np.ascontiguousarray(values.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def trained(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after some rounds over all blocks."""
    context = blocks.sparkSession.sparkContext
    rows = blocks.rdd
    tasks = max(1, rows.getNumPartitions())
    depth = 2 if tasks <= 1024 else 3
    for _ in range(rounds):
        shared = context.broadcast(books)  # of the codebooks' size
        zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))

        def add(state: tuple, r, shared=shared) -> tuple:
            return added(state, components(r.data, r.width, r.rows), shared.value)

        sums, counts = rows.treeAggregate(zero, add, merged, depth)
        mean = sums.astype(object) // np.maximum(counts, 1)[:, :, None].astype(object)
        books = np.where(counts[:, :, None] > 0, mean, books.astype(object))
        books = books.astype(np.int64) if magnitude(books) < _SAFE else books
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    size, shared = books.shape[0] * books.shape[2], vectors.sparkSession.sparkContext.broadcast(books)
    schema = StructType([vectors.schema["vec_id"], vectors.schema["label"], StructField("code", StringType()), StructField("error", LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                block = floors(np.ascontiguousarray(entries(part.column(2), size).T), SCALE)
                index, least = nearest(block, shared.value)
                text = np.ascontiguousarray(index.T.astype(np.uint8)).tobytes().hex()
                codes = [text[i : i + 2 * len(index)] for i in range(0, len(text), 2 * len(index))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array([e if e < 1 << 63 else None for e in least.sum(axis=0).tolist()], pa.int64())], schema.names)

    return vectors.select("vec_id", "label", "embedding").mapInArrow(each, schema)


def compress(table: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256. ``size`` is at most 256."""
    vectors = kept_vectors(table, "vec_id", "label")
    books = first_books(vectors, parts, size)
    kinds = [vectors.schema["vec_id"], StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())]
    if books is None:
        return table.sparkSession.createDataFrame([], StructType(kinds))
    books = trained(settle(blocks_of(vectors, books.shape[0] * books.shape[2]), "blocks"), books, rounds)
    rows = settle(coded(vectors, books), "codes").withColumn("_label", F.struct("label"))  # a struct is equal to itself, null or not
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    labels = settle(rows.groupBy("_label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    out = salted_join(rows, labels, "_label", "_n", F.struct("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
