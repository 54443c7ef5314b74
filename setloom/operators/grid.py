"""How many words samples share, counted in the cells of a grid: no row for a pair is ever shuffled.

Samples are dealt to blocks, ranges of their ids with about as many postings each. A block's postings are packed in one row.
Each two blocks, and each block with itself, are a cell of the grid: a Cartesian product of the packed rows, which is shuffled
once and read by every cell that needs it, so what is shuffled grows with the postings, however many blocks there are. A cell
has all words of its samples, so one task counts their pairs to the end. It does so in strips of rows, whose counts stand in
one array of bounded size, and hands over finished pairs: each row's in the order of columns, a stretch of columns a cell
(or, if asked, in an order in which they are written in less room).

A cell's postings are in memory at once, about twice ``BLOCK`` of them, and up to as much more as the largest sample has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import PairMarks

#: Postings of a block, about.
BLOCK = 1 << 21
#: Blocks at least, so that there are 78 cells for tasks.
LEAST_BLOCKS = 12
#: Cells of a strip's counts, and pairs of postings that are added to them at once.
STRIP = 1 << 17
#: Of a tile of pairs that come by words: columns, rows at most, and about as many pairs of postings.
TILE_COLUMNS, TILE_ROWS, TILE = 1 << 11, 1 << 10, 1 << 20
#: A strip with fewer pairs of postings than this part of its cells has them sorted; its cells are not counted one by one.
FEW = 8
#: Pairs of a cell from which those that are not among the chosen are sorted out again, at least.
POOL = 1 << 17
#: Rows that a task hands over at once.
ROWS = 1 << 17
#: A share that is asked for is taken a little lower, so that rounding never drops a pair that the exact filter keeps.
_SLACK = 1 - 1e-9


def number_of_blocks(postings: int, block: int = BLOCK) -> int:
    return max(LEAST_BLOCKS, -(-postings // block))


class _Side:
    """Postings of a block by word: its samples ascending, their sizes, and the place in them of each posting's sample."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, kmer: np.ndarray, weight: np.ndarray | None):
        self.ids, self.of, self.kmer, self.weight = ids, of, kmer, weight
        self.sizes = np.bincount(of, minlength=len(ids))


def _strips(rows: int, width: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have ``limit`` cells at most, or are of one row."""
    step = max(1, limit // width)
    for at in range(0, rows, step):
        yield at, min(rows, at + step)


def _parts(ends: np.ndarray, a: int, b: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of what lies from ``a`` to ``b`` that cost ``limit`` at most, or are of one; ``ends`` are the costs, summed up."""
    while a < b:
        e = min(b, max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1))
        yield a, e
        a = e


def _counts(x: _Side, y: _Side, strip: int, every: bool, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, words in common) of samples of ``x`` with those of ``y``, by row and column, of pairs that share as many words as
    their row ``need``s, one at least; with zeros if ``every`` pair is asked for."""
    begins = np.flatnonzero(np.concatenate([[True], y.kmer[1:] != y.kmer[:-1]])) if len(y.kmer) else np.zeros(0, np.int64)
    words, times = y.kmer[begins], np.diff(np.append(begins, len(y.kmer)))
    place = np.searchsorted(words, x.kmer)
    met = np.flatnonzero(words[np.minimum(place, len(words) - 1)] == x.kmer) if len(words) else np.zeros(0, np.int64)
    met = met[np.argsort(x.of[met], kind="stable")]
    of, place = x.of[met].astype(np.int64), place[met]
    first, times, weight = begins[place], times[place], None if x.weight is None else x.weight[met]
    rows = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(x.ids)))])
    ends, ramp = np.concatenate([[0], np.cumsum(times)]), np.arange(0)
    width = max(1, len(y.ids))
    for low, high in _strips(len(x.ids), width, strip):
        a, b, cells = int(rows[low]), int(rows[high]), (high - low) * width
        if a == b and not every:
            continue
        few = not every and int(ends[b] - ends[a]) * FEW < cells
        counts = None
        for s, e in [(a, b)] if few else _parts(ends, a, b, strip):
            n, size = times[s:e], int(ends[e] - ends[s])
            if size > len(ramp):
                ramp = np.arange(size)
            at = np.repeat(first[s:e] - (ends[s:e] - ends[s]), n)
            at += ramp[:size]
            cell = np.repeat((of[s:e] - low) * width, n)
            cell += y.of.take(at)
            add = None if weight is None else np.repeat(weight[s:e], n)
            if few:
                if add is None:
                    cell.sort()
                else:
                    order = np.argsort(cell)
                    cell, add = cell[order], add[order]
                starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                found = cell[starts]
                common = np.diff(np.append(starts, size)) if add is None else np.add.reduceat(add, starts)
            else:
                more = np.bincount(cell, add, cells)  # doubles hold numbers of words exactly
                counts = more if counts is None else np.add(counts, more, out=counts)
        if few:
            i, j = np.divmod(found, width)
            i += low
            keep = common >= need[i]
            yield i[keep], j[keep], common[keep]
            continue
        counts = np.zeros(cells, np.int64) if counts is None else counts
        wanted = np.zeros(-(-cells // 8) * 8, bool)
        if len(y.ids):
            np.greater_equal(counts.reshape(-1, width), 0 if every else need[low:high, None], out=wanted[:cells].reshape(-1, width))
        found = _places(wanted)
        i = np.repeat(np.arange(low, high), np.diff(np.searchsorted(found, np.arange(high - low + 1) * width)))
        yield i, found - (i - low) * width, counts[found].astype(np.int64, copy=False)


def _places(wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted``, of eight times as many bytes as some number, is true. Where few are, eight are looked at at once."""
    if np.count_nonzero(wanted) * 24 > len(wanted):
        return np.flatnonzero(wanted)
    eights = np.flatnonzero(wanted.view(np.int64))
    at = np.flatnonzero(wanted.reshape(-1, 8)[eights].ravel())
    return eights[at >> 3] * 8 + (at & 7)


def _best(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` first partners of each row, by value downwards, then by column."""
    order = np.lexsort((col, -value, row))
    starts = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < n]


def may_be_best(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Of pairs by row: which have one of the ``n`` highest values of their row."""
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    times, left = np.diff(np.append(starts, len(row))), value
    for _ in range(n - 1):
        top = np.repeat(np.maximum.reduceat(left, starts), times)
        left = np.where(left < top, left, -1.0)
    return value >= np.repeat(np.maximum.reduceat(left, starts), times)


class _Chosen:
    """Of pairs (row, column, common) that come by ascending rows: those that may be among the ``n`` of highest value for their row,
    or for their column. ``ties``: of equal values, all are kept; else those of the first partners."""

    def __init__(self, n: int, columns: int, ties: bool):
        self.n, self.ties, self.reached = n, ties, np.full(columns, -1.0)
        self.found: list[list[np.ndarray]] = []
        self.pool: list[list[np.ndarray]] = []
        self.held = 0

    def _first(self, one: np.ndarray, other: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Places of those that are chosen of pairs by ``one``."""
        kept = np.flatnonzero(may_be_best(one, value, self.n))
        return kept if self.ties else kept[_best(one[kept], other[kept], value[kept], self.n)]

    def add(self, pairs: list[np.ndarray], by_row: np.ndarray, by_column: np.ndarray) -> None:
        """``pairs`` of whole rows. Columns that have enough pairs already ask for a higher value than these."""
        i, j, _ = pairs
        mine = self._first(i, j, by_row)
        self.found.append([c[mine] for c in pairs])
        at = np.flatnonzero(by_column >= self.reached[j] if self.ties else by_column > self.reached[j])
        self.pool.append([*(c[at] for c in pairs), by_column[at]])
        self.held += len(at)
        if self.held >= max(POOL, 4 * self.n * len(self.reached)):
            self._sort_out()

    def _sort_out(self) -> None:
        i, j, common, value = (np.concatenate(c) for c in zip(*self.pool, strict=True))
        if not len(i):
            return
        order = np.argsort(j, kind="stable")
        kept = order[self._first(j[order], i[order], value[order])]
        kept = kept[np.lexsort((-value[kept], j[kept]))]
        self.pool, self.held = [[c[kept] for c in (i, j, common, value)]], len(kept)
        starts = np.flatnonzero(np.concatenate([[True], j[kept][1:] != j[kept][:-1]]))
        enough = np.diff(np.append(starts, len(kept))) >= self.n
        last = kept[starts[enough] + self.n - 1]
        self.reached[j[last]] = value[last]

    def pairs(self) -> list[np.ndarray]:
        """The chosen, each once."""
        if not self.found:
            return [np.zeros(0, np.int64)] * 3
        self._sort_out()
        i, j, common = (np.concatenate(c) for c in zip(*self.found, *(p[:3] for p in self.pool), strict=True))
        _, once = np.unique(i * len(self.reached) + j, return_index=True)
        return [i[once], j[once], common[once]]


def in_runs(i: np.ndarray, j: np.ndarray, common: np.ndarray, by_size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a strip, by row, with each row's by words in common and the column's size, so that those of one value are next to
    each other. ``by_size`` are the columns by size, ``rank`` their places there."""
    low, of_rank, of_common = int(i[0]), max(1, len(rank) - 1).bit_length(), int(common.max()).bit_length()
    if int(i[-1] - low).bit_length() + of_common + of_rank > 62:  # the order is of use, but nothing depends on it
        return i, j, common
    rest = (((i - low) << of_common | common) << of_rank) | rank[j]
    rest.sort()
    cell = rest >> of_rank
    return (cell >> of_common) + low, by_size[rest & ((1 << of_rank) - 1)], cell & ((1 << of_common) - 1)


def _by_words(x: _Side, y: _Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, words in common) of the pairs that share a word, with col < row if the sides are the ``same``, each once, in an
    order in which columns are written in little room: by the word of most pairs that they share, then by row and column.

    The rows of a word then have the same columns one after the other, but for those that an earlier word had. Parquet packs
    eight numbers to whole bytes, and these repeat where stretches are of a multiple of eight; what is over follows in the
    order of ``in_runs``. Samples are put in order of their sizes, so that values repeat as well. Pairs come by tiles of rows
    and columns, of which a task holds one.
    """
    begins = np.flatnonzero(np.concatenate([[True], y.kmer[1:] != y.kmer[:-1]])) if len(y.kmer) else np.zeros(0, np.int64)
    words, times = y.kmer[begins], np.diff(np.append(begins, len(y.kmer)))
    place = np.searchsorted(words, x.kmer)
    met = np.flatnonzero(words[np.minimum(place, len(words) - 1)] == x.kmer) if len(words) else np.zeros(0, np.int64)
    if not len(met):
        return
    place, by_row, by_column = place[met], np.argsort(x.sizes, kind="stable"), np.argsort(y.sizes, kind="stable")
    at_row, at_column = np.empty_like(by_row), np.empty_like(by_column)
    at_row[by_row], at_column[by_column] = np.arange(len(by_row)), np.arange(len(by_column))
    made = np.bincount(place, minlength=len(words)) * times
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-made, kind="stable")] = np.arange(len(words))
    row, word = at_row[x.of[met]], rank[place]
    cost = np.concatenate([[0], np.cumsum(np.bincount(row, times[place], len(by_row)).astype(np.int64))])
    tiles = -(-len(by_column) // TILE_COLUMNS)
    rows = [r for part in _parts(cost, 0, len(by_row), TILE * tiles) for r in range(part[0], part[1], TILE_ROWS)] + [len(by_row)]
    tile = np.searchsorted(rows, row, "right") - 1
    order = np.lexsort((row, word, tile))
    row, word, weight = row[order], word[order], None if x.weight is None else x.weight[met][order]
    bounds = np.searchsorted(tile[order], np.arange(len(rows)))
    # postings of the columns' words, by tile: column, and where each word begins
    theirs, column = np.repeat(rank, times), at_column[y.of]
    wanted = np.repeat(made > 0, times)
    theirs, column = theirs[wanted], column[wanted]
    order = np.lexsort((column, theirs, column // TILE_COLUMNS))
    theirs, column = theirs[order], column[order]
    cuts = np.searchsorted(column // TILE_COLUMNS, np.arange(tiles + 1)) if tiles == 1 else np.concatenate([[0], np.cumsum(np.bincount(column // TILE_COLUMNS, minlength=tiles))])
    sides = [(t * TILE_COLUMNS, column[a:b] - t * TILE_COLUMNS, np.searchsorted(theirs[a:b], np.arange(len(words) + 1))) for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    first = np.empty(TILE_ROWS * TILE_COLUMNS, np.int32)
    for low, high, a, b in zip(rows[:-1], rows[1:], bounds[:-1], bounds[1:], strict=True):
        over: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for left, columns, starts in sides:
            begin = starts[word[a:b]]
            n = starts[word[a:b] + 1] - begin
            some = np.flatnonzero(n)
            begin, n = begin[some], n[some]
            ends = np.cumsum(n)
            size = int(ends[-1]) if len(ends) else 0
            if not size:
                continue
            ramp = np.arange(size, dtype=np.int32)
            at = np.repeat(begin - (ends - n), n)
            at += ramp
            cell = np.repeat((row[a:b][some] - low) * TILE_COLUMNS, n)
            cell += columns.take(at)
            counts = np.bincount(cell, None if weight is None else np.repeat(weight[a:b][some], n), (high - low) * TILE_COLUMNS)
            first[cell[::-1]] = ramp[::-1]  # of several, the last that is set stays: the first of all
            new = first.take(cell) == ramp
            if same:
                new &= by_column[(cell & (TILE_COLUMNS - 1)) + left] < by_row[(cell >> TILE_COLUMNS.bit_length() - 1) + low]
            found = np.flatnonzero(new)
            cell = cell[found]
            part = np.diff(np.searchsorted(found, np.concatenate([[0], ends])))
            whole = np.arange(len(found)) - np.repeat(np.cumsum(part) - part, part) < np.repeat(part & ~7, part)
            pairs = (cell >> TILE_COLUMNS.bit_length() - 1) + low, (cell & (TILE_COLUMNS - 1)) + left, counts[cell].astype(np.int64, copy=False)
            if whole.any():
                i, j, common = (c[whole] for c in pairs)
                yield by_row[i], by_column[j], common
            over.append(tuple(c[~whole] for c in pairs))
        if over:
            i, j, common = (np.concatenate(c) for c in zip(*over, strict=True))
            order = np.argsort(i, kind="stable")
            if len(order):
                i, j, common = in_runs(i[order], j[order], common[order], np.arange(len(by_column)), np.arange(len(by_column)))
                yield by_row[i], by_column[j], common


#: What a packed block has, beside its number: see ``_Side``.
_PACKED = ["ids", "of", "kmer", "weight"]


def range_of(rows: DataFrame, column: str, ranges: int) -> Column:
    """The range, from 0, that a value is in, of ranges with about as many of ``rows`` each."""
    found = rows.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(found or []))

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) < bounds[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def counted(
    post: DataFrame,
    blocks: int,
    samples: DataFrame | None = None,
    share: float = 0.0,
    least: int = 1,
    weight: str | None = None,
    best: int | None = None,
    strip: int = STRIP,
    runs: bool = False,
    seed: int | None = None,
    sizes: bool = True,
) -> DataFrame:
    """(row_id, col_id, common, n_row, n_col) of each pair with col_id < row_id that shares ``least`` words and ``share`` of the
    larger set; sizes are numbers of postings (sample_id, kmer).

    ``samples`` (sample_id) asks for every pair of them, zeros included. With ``weight`` a posting counts for as many words.
    ``best``: of the pairs of a cell, those that are among this many best by Jaccard for one of their samples, or with a ``seed``
    by the least hash (``functions.digests``); what is best of all is among them. ``runs``: pairs don't come in the
    order of rows and columns but in that of ``_by_words``, or with bounds of ``in_runs``, so that they are written in less
    room. Without ``sizes`` there are no n_row and n_col.
    """
    kept = post.where("sample_id is not null and kmer is not null")
    rows = kept.select(F.col("sample_id").cast("long").alias("sample_id"), "kmer", *([F.col(weight).alias("weight")] if weight else []))
    if samples is not None:
        every = samples.where("sample_id is not null").select(F.col("sample_id").cast("long").alias("sample_id"), F.lit(None).cast("long").alias("kmer"))
        rows = rows.unionByName(every, allowMissingColumns=True)
    every_pair, weighted = samples is not None, weight is not None  # functions are sent to tasks without tables
    names = ["row_id", "col_id", "common", *(["n_row", "n_col"] if sizes else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        at = t.column("block").to_numpy()
        for block in np.unique(at).tolist():  # one, but for where blocks share a partition
            part = t.filter(pa.array(at == block))
            ids, of = np.unique(part.column("sample_id").to_numpy(), return_inverse=True)
            known = part.column("kmer").is_valid().to_numpy()
            kmer = part.column("kmer").fill_null(0).to_numpy()[known]
            order = np.argsort(kmer, kind="stable")
            weights = part.column("weight").fill_null(0).to_numpy()[known][order].astype(np.int64).tobytes() if weighted else b""
            packed = [ids.tobytes(), of[known][order].astype(np.int32).tobytes(), kmer[order].tobytes(), weights]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["block", *_PACKED])

    dealt = rows.select(range_of(rows, "sample_id", blocks).alias("block"), *rows.columns).repartitionById(blocks, "block")
    packed = dealt.mapInArrow(pack, "block int, " + ", ".join(f"{c} binary" for c in _PACKED)).repartitionById(blocks, "block")
    x, y = (packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in ("x", "y"))
    # the hint names the Cartesian product: what is packed is read by each cell from where it lies, and not broadcast
    cells = x.hint("shuffle_replicate_nl").join(y, F.col("y_block") <= F.col("x_block"))

    def side(batch: pa.RecordBatch, row: int, name: str) -> _Side:
        ids, of, kmer, weights = (np.frombuffer(batch.column(f"{name}_{c}")[row].as_buffer(), t) for c, t in zip(_PACKED, (np.int64, np.int32, np.int64, np.int64), strict=True))
        return _Side(ids, of, kmer, weights if weighted else None)

    def pairs(x: _Side, y: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        if runs and best is None and not every_pair and share <= 0 and least <= 1:
            for i, j, common in _by_words(x, y, same):
                yield from batched(x, y, i, j, common)
            return
        by_size = np.argsort(y.sizes, kind="stable")
        rank = np.empty_like(by_size)
        rank[by_size] = np.arange(len(by_size))
        need = np.maximum(max(1, least), np.ceil(share * _SLACK * x.sizes)).astype(np.int64)
        chosen = None if best is None else _Chosen(best, len(y.ids), seed is not None)
        marks = None if seed is None else PairMarks(x.ids, y.ids, seed)
        for i, j, common in _counts(x, y, strip if marks is None else 4 * strip, every_pair, need):
            if same or share > 0:
                keep = np.ones(len(i), bool) if not same else j < i
                if share > 0:
                    keep &= common >= share * _SLACK * np.maximum(x.sizes[i], y.sizes[j])
                i, j, common = i[keep], j[keep], common[keep]
            if not len(i):
                continue
            if marks is not None:
                chosen.add([i, j, common], *marks.of(i, j))
            elif chosen is not None:
                value = common / (x.sizes[i] + y.sizes[j] - common)
                chosen.add([i, j, common], value, value)
            else:
                yield from batched(x, y, *(in_runs(i, j, common, by_size, rank) if runs else (i, j, common)))
        if chosen is not None:
            yield from batched(x, y, *chosen.pairs())

    def batched(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [x.ids[i], y.ids[j], common, *([x.sizes[i], y.sizes[j]] if sizes else [])]
        whole = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names)
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("x_block")[row].as_py() == batch.column("y_block")[row].as_py()
                yield from pairs(side(batch, row, "x"), side(batch, row, "y"), same)

    return cells.mapInArrow(each, ", ".join(f"{c} long" for c in names))
