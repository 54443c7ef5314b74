"""Tables as text: counts and values, dense or sparse, and Phylip matrices.

Lines are put together of pieces (at, first, last, text): what stands before the cells, and stretches of cells as far as pairs
come in the order of their columns. So what is shuffled is text, once, dealt by ranges of rows; there is no row for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import range_of
from ..operators.order import numbered

#: Ids of a block in which columns are put in order.
_BLOCK = 1 << 16
#: Zeros that a piece holds between two cells at most, and characters of lines that a task hands over at once.
_ZEROS, _TEXT = 1 << 10, 1 << 24
_PIECE = "at long, first long, last long, text string"


def number(value: Column) -> Column:
    """A value as text: 0, or six decimals. No value (an empty sample) is 0."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, F.lit("0")).otherwise(F.format_string("%.6f", value.cast("double")))


def _cells(pairs: DataFrame, text: Column, separator: str) -> DataFrame:
    """(row_id, cells): the cells of each row by column, each followed by the separator."""
    rows = pairs.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", text.alias("cell")))).alias("_c"))
    return rows.select("row_id", F.concat_ws("", F.transform("_c", lambda x: F.concat(x["cell"], F.lit(separator)))).alias("cells"))


def _pieces(cells: DataFrame, zero: str = "") -> DataFrame:
    """Pieces of ``cells`` (at, first, text), a stretch of cells each; with ``zero``, zeros are written between the places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, place = (batch.column(k).to_numpy() for k in (0, 1))
            text = batch.column(2)
            if np.any((at[1:] < at[:-1]) | ((at[1:] == at[:-1]) & (place[1:] < place[:-1]))):
                order = np.lexsort((place, at))
                at, place, text = at[order], place[order], text.take(pa.array(order))
            gap = np.diff(place) - 1
            cut = np.flatnonzero((at[1:] != at[:-1]) | (bool(zero) & (gap > _ZEROS))) + 1
            begin = np.concatenate([[0], cut])
            if zero:
                between = np.concatenate([[0], gap])
                between[begin] = 0
                zeros = pc.binary_repeat(pa.array([zero] * len(at)), pa.array(between))
                text = pc.binary_join_element_wise(zeros, text, "")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), text), "")
            last = np.append(cut, len(at)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(at[begin]), pa.array(place[begin]), pa.array(place[last]), joined], ["at", "first", "last", "text"])

    return cells.select("at", "first", "text").mapInArrow(each, _PIECE)


def _line(pieces: list[tuple[int, int, str]], separator: str, zero: str) -> tuple[list[int], list[str]]:
    """How many places are free before each piece of a line, and its texts. Pieces that lie within each other are taken apart to
    cells."""
    if any(f <= before for (_, before, _), (f, _, _) in zip(pieces[1:], pieces[2:], strict=False)):
        cells: dict[int, str] = {}
        for first, _, text in pieces[1:]:
            for k, cell in enumerate(text.split(separator)[:-1]):
                place = first + k if zero else int(cell.partition(":")[0])
                if not zero or cell + separator != zero:
                    cells[place] = cell + separator
        ends = [p for p in pieces[1:] if not p[2]]
        pieces = [pieces[0], *((k, k, cells[k]) for k in sorted(cells)), *ends]
    free = [0, *(first - before - 1 for (_, before, _), (first, _, _) in zip(pieces, pieces[1:], strict=False))]
    return free, [text for _, _, text in pieces]


def _lines(pieces: DataFrame, rows: DataFrame, separator: str = ",", zero: str = "") -> DataFrame:
    """(at, line) of pieces, in order: a partition has a range of rows, and those before it are less. A line begins with the
    piece of place -1; rows without it are no lines."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartitionById(n, range_of(rows.select(F.col("sample_id").alias("at")), "at", n)).sortWithinPartitions("at", "first")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        now, done, size = None, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            if done:
                at, free, texts = (pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True))
                yield pa.RecordBatch.from_arrays([at, free, texts], ["at", "free", "texts"])

        for batch in batches:
            for at, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if held and held[0][0] == -1:
                        done.append((now, *_line(held, separator, zero)))
                        size += sum(map(len, done[-1][2]))
                    held, now = [], at
                    if size >= _TEXT:
                        yield from finished()
                        done, size = [], 0
                held.append(tuple(piece))
        if held and held[0][0] == -1:
            done.append((now, *_line(held, separator, zero)))
        yield from finished()

    out = dealt.mapInArrow(each, "at long, free array<int>, texts array<string>")
    filled = F.zip_with("free", "texts", lambda n, text: F.concat(F.repeat(F.lit(zero), n), text)) if zero else F.col("texts")
    return out.select("at", F.array_join(filled, "").alias("line"))


def _whole(lines: DataFrame) -> DataFrame:
    """Pieces that are lines (at, line)."""
    return lines.select("at", F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"), F.col("line").alias("text"))


def _table(heads: DataFrame, rows: DataFrame, columns: DataFrame, pairs: DataFrame, text: Column, lead: Column, sparse: bool, zeros: str | None, separator: str = ",") -> DataFrame:
    """(at, line) of a table, in order: ``heads``, and a line a row. Of a dense table, ``pairs`` need not hold the cells that are 0
    if ``zeros`` says where they are: these are written between them.

    A row of a ``triangle`` has the columns before its own, one of a ``rectangle`` all. The columns' places are broadcast;
    a header line names them all.
    """
    leads = _whole(rows.select(F.col("sample_id").cast("long").alias("at"), lead.alias("line")))
    pieces = _whole(heads).unionAll(leads)
    if not zeros and not sparse:
        whole = _cells(pairs, text, separator)
        end = F.lit(0).cast("long")
        return _lines(pieces.unionAll(whole.select(F.col("row_id").cast("long"), end, end, "cells")), rows, separator)
    if not zeros:
        cell = F.concat((F.col("col_id") + 1).cast("string"), F.lit(":"), text, F.lit(separator))
        found = pairs.select(F.col("row_id").cast("long").alias("at"), F.col("col_id").cast("long").alias("first"), cell.alias("text"))
        return _lines(pieces.unionAll(_pieces(found)), rows, separator)
    zero = f"0{separator}"
    placed = numbered(columns.select("sample_id", F.floor(F.col("sample_id") / _BLOCK).alias("_block")), ["_block"], ["sample_id"], "_column").select("sample_id", F.col("_column").cast("long").alias("_column"))
    met = pairs.join(F.broadcast(placed.withColumnRenamed("sample_id", "col_id")), "col_id")
    found = met.select(F.col("row_id").cast("long").alias("at"), F.col("_column").alias("first"), F.concat(text, F.lit(separator)).alias("text"))
    if zeros == "triangle":
        ends = placed.select(F.col("sample_id").cast("long").alias("at"), F.col("_column").alias("first"))
    else:
        ends = rows.select(F.col("sample_id").cast("long").alias("at")).crossJoin(F.broadcast(columns.agg(F.count(F.lit(1)).alias("first"))))
    ends = ends.select("at", "first", F.col("first").alias("last"), F.lit("").alias("text"))
    return _lines(pieces.unionAll(_pieces(found, zero)).unionAll(ends), rows, separator, zero)


def _joined(samples: DataFrame, column: str) -> DataFrame:
    listed = samples.agg(F.array_sort(F.collect_list(F.struct("sample_id", F.col(column).cast("string").alias("x")))).alias("_l"))
    return listed.select(F.concat_ws("", F.transform("_l", lambda s: F.concat(s["x"], F.lit(",")))).alias("line"))


def _header(columns: DataFrame, k: int, fraction: float, lead: str) -> DataFrame:
    start = f"kmer-length: {k} fraction: {fraction:g} ,{lead}"
    return _joined(columns, "name").select(F.lit(-2).cast("long").alias("at"), F.concat(F.lit(start), "line").alias("line"))


def counts_lines(rows: DataFrame, columns: DataFrame, pairs: DataFrame, k: int, fraction: float, sparse: bool = False, zeros: str | None = None) -> DataFrame:
    """(at, line): a table of counts. For a dense one, ``pairs`` must hold the zeros too, or ``zeros`` says where they are: in a
    ``triangle`` or a ``rectangle``."""
    counts = _joined(columns, "n_kmers").select(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("query-samples,total-kmers,"), "line").alias("line"))
    text = F.col("common").cast("string")
    lead = F.concat("name", F.lit(","), F.col("n_kmers").cast("string"), F.lit(","))
    return _table(_header(columns, k, fraction, "db-samples ,").unionAll(counts), rows, columns, pairs, text, lead, sparse, zeros)


def values_lines(rows: DataFrame, columns: DataFrame, values: DataFrame, k: int, fraction: float, sparse: bool = False, zeros: str | None = None) -> DataFrame:
    """(at, line): a table of values (row_id, col_id, value). ``zeros``: as for ``counts_lines``, if pairs that share nothing have
    the value 0."""
    text = number(F.col("value"))
    return _table(_header(columns, k, fraction, ""), rows, columns, values, text, F.concat("name", F.lit(",")), sparse, zeros)


def phylip_lines(samples: DataFrame, values: DataFrame, zeros: str | None = None) -> DataFrame:
    """(at, line): the number of samples, then a line each with its values; always dense. ``zeros``: as for ``values_lines``."""
    text = number(F.col("value"))
    count = samples.agg(F.count(F.lit(1)).cast("string").alias("line")).select(F.lit(-1).cast("long").alias("at"), "line")
    return _table(count, samples, samples, values, text, F.concat("name", F.lit(" ")), False, zeros, " ")


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", ordered: bool = False, compression: str = "none") -> None:
    """Write lines in order; files sort by name as their lines do. ``ordered``: they come so, as this module's tables do."""
    (lines if ordered else lines.orderBy("at")).select("line").write.mode(mode).text(path, compression=compression)
