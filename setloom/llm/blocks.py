"""Texts as numbers in a dictionary of their block, and what is found for its units brought back to the block.

A block is some documents that stand one after another in a partition; its size is bounded. A task splits the block's
texts into units (words, pre-tokens) and gives each distinct unit a place, the most frequent one the first. Two kinds of
rows leave the task, in one exchange: the documents, with their places packed into bytes, are dealt by block; and the
block's units, each once however often texts hold it, are dealt by unit. A unit's rows are as many as blocks hold it, and
short, so no key is hot. There the distinct units are resolved once for all texts; what is found is joined to the units,
dealt to the blocks, and met there by the documents, which have not moved again.

Places depend on the order of rows in a partition. A lost task is run again on the same rows, so its places are the same
if the input is read from storage, or in a fixed order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

#: Characters from which a block is closed: what a task holds at once, beside one batch.
BLOCK_CHARS = 16_000_000
#: Documents of one row.
ROW_DOCUMENTS = 64
#: Rows that are packed for their blocks at once.
PACK_ROWS = 200_000

Splitter = Callable[[str], Iterable[str]]
#: From the places of each document's units, in order, to the numbers that are kept of them.
Streams = Callable[[list[np.ndarray]], list[np.ndarray]]
#: From some documents' carried columns and streams to columns of the result.
Finish = Callable[[list[pa.Array], list[np.ndarray]], list[pa.Array]]


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as bytes: all lowest bytes, then all second ones and so on, compressed; and how many."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    planes = pa.Codec("zstd", 1).decompress(memoryview(data)[4:], 4 * size)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, size).T).view("<u4").ravel().astype(np.int64)


def block_key(block: int) -> str:
    """The key of a block; no unit begins with a space."""
    return f" {block}"


class _Block:
    def __init__(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.rows: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        self.chars = 0

    def add(self, part: pa.RecordBatch, split: Splitter) -> None:
        places, at = [], self.index
        for text in part.column(part.num_columns - 1):
            text = text.as_py() or ""
            places.append(np.fromiter(map(at.__getitem__, split(text)), np.int32))
            self.chars += len(text)
        self.rows.append((part.select(range(part.num_columns - 1)), places))

    def ranks(self) -> np.ndarray:
        """Each unit's place by frequency."""
        counts = np.zeros(len(self.index), np.int64)
        for _, places in self.rows:
            counts += np.bincount(np.concatenate(places), minlength=len(counts))
        out = np.empty(len(counts), np.int64)
        out[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        return out


def dealt(docs: DataFrame, carried: list[str], splitter: Callable[[], Splitter], streams: Streams, longest: int | None = None) -> DataFrame:
    """(key, block, place, docs, data), dealt by key.

    A unit's row has the unit as its key, and no data. Rows with a block's key have the carried columns of some documents,
    as structs (c0, c1, ...), and the streams of those documents; or no documents, and as data a unit of more than
    ``longest`` characters, which stays with its block.
    """
    columns = [F.col(f"`{c}`") for c in carried] or [F.lit(0).alias("none")]
    source = docs.select(*columns, "text")
    kinds = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(source.schema.fields[:-1])])
    # what is never null is said so: else the planner tests it on one side of the shared exchange only
    fields = [StructField("key", StringType(), False), StructField("block", LongType(), False), StructField("place", IntegerType(), False)]
    schema = StructType([*fields, StructField("docs", ArrayType(kinds)), StructField("data", ArrayType(BinaryType()))])

    def batch(keys: list[str], block: int, places: np.ndarray, docs: pa.Array, data: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.full(len(keys), block)), pa.array(places, pa.int32()), docs, data], schema.names)

    def rows_of(block: int, held: _Block) -> Iterator[pa.RecordBatch]:
        key, rank = block_key(block), held.ranks()
        for at in range(len(held.rows)):
            part, places = held.rows[at]
            held.rows[at] = None  # what has left needs no memory
            whole = pa.StructArray.from_arrays(part.columns, kinds.names)
            data = pa.array([[packed(s) for s in streams([rank[p] for p in places])]], pa.list_(pa.binary()))
            yield batch([key], block, np.array([at]), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), data)
        none, no_data = pa.list_(whole.type), pa.list_(pa.binary())
        held.index.default_factory = None  # it refers to the dictionary itself, which would outlive the block
        units = sorted(held.index)  # they compress better
        for at in range(0, len(units), 50_000):
            part = units[at : at + 50_000]
            places = rank[[held.index[u] for u in part]]
            long = np.array([longest is not None and len(u) > longest for u in part])
            keys = [u for u, x in zip(part, long, strict=True) if not x]
            yield batch(keys, block, places[~long], pa.nulls(len(keys), none), pa.nulls(len(keys), no_data))
            if long.any():
                stay = [[u.encode("utf-8", "surrogatepass")] for u, x in zip(part, long, strict=True) if x]
                yield batch([key] * len(stay), block, places[long], pa.nulls(len(stay), none), pa.array(stay, no_data))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, held = splitter(), TaskContext.get().partitionId() << 24, _Block()
        for b in batches:
            for at in range(0, b.num_rows, ROW_DOCUMENTS):
                held.add(b.slice(at, ROW_DOCUMENTS), split)
                if held.chars >= BLOCK_CHARS:
                    yield from rows_of(block, held)
                    block, held = block + 1, _Block()
            del b  # not to be held beside the next one
        if held.rows:
            yield from rows_of(block, held)

    return source.mapInArrow(each, schema).repartition("key")


def _only(rows: DataFrame, own: Column) -> DataFrame:
    """The rows for which ``own`` holds. As the condition is not deterministic, it stays above the exchange, which is shared."""
    return rows.where(own == (F.spark_partition_id() >= 0))


def _unit_rows(rows: DataFrame) -> DataFrame:
    """(key, block, place) of units, still dealt by key."""
    # every column is read here, as the documents' side does, so that all sides are one exchange
    own = F.col("data").isNull() & F.col("docs").isNull() & (F.col("block") >= 0) & (F.col("place") >= 0)
    return _only(rows, own).select("key", "block", "place")


def distinct_units(rows: DataFrame) -> DataFrame:
    """(unit), each once, still dealt by it."""
    return _unit_rows(rows).select(F.col("key").alias("unit")).distinct()


def for_blocks(rows: DataFrame, resolved: DataFrame, value: str) -> DataFrame:
    """(key, data): for each block, the places and the values of its units. ``resolved`` has (unit, value), dealt by unit.

    A value is a whole number, or a list of them.
    """
    joined = _unit_rows(rows).join(resolved, F.col("key") == F.col("unit")).select("block", "place", value)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        block, place, values = t["block"].to_numpy(), t["place"].to_numpy(), t[value].combine_chunks()
        cuts = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block)]
        keys, data = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = values.slice(a, b - a)
            numbers = [part.value_lengths(), part.flatten()] if pa.types.is_list(part.type) else [part]
            keys.append(block_key(block[a]))
            data.append([packed(x) for x in (place[a:b], *(n.to_numpy() for n in numbers))])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.list_(pa.binary()))], ["key", "data"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK_ROWS:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return joined.mapInArrow(each, StructType([StructField("key", StringType(), False), StructField("data", ArrayType(BinaryType()))]))


def by_block(rows: DataFrame, values: DataFrame, finish: Callable[[list[np.ndarray], list[str], np.ndarray], Finish], schema: StructType) -> DataFrame:
    """What ``finish`` makes of each block's documents, with the columns of ``schema``.

    It gets the arrays of the block's places and values (none if no unit was dealt), and the units that stayed with the
    block, with their places. What it returns is called for each row of documents, with their carried columns and streams.
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.concatenate(x) for x in zip(*([unpacked(x) for x in d] for d in right["data"].to_pylist()), strict=True)]
        rest = left.filter(pc.is_null(left["docs"]))
        of = finish(found, [x[0].decode("utf-8", "surrogatepass") for x in rest["data"].to_pylist()], rest["place"].to_numpy())
        out = []
        for b in left.filter(pc.is_valid(left["docs"])).sort_by("place").to_batches(max_chunksize=1):
            whole = b.column("docs").flatten()
            columns = [pc.struct_field(whole, k) for k in range(whole.type.num_fields)]
            out.append(pa.Table.from_arrays(of(columns, [unpacked(x) for x in b.column("data")[0].as_py()]), schema.names))
        return pa.concat_tables(out)

    return _only(rows, F.col("data").isNotNull()).groupBy("key").cogroup(values.groupBy("key")).applyInArrow(block, schema)
