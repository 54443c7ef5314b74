"""The questions that can be asked of indexes, each in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import ZERO_APART
from ..operators import extract, grid, overlap, select
from ..sources.counts_table import CountsTable, read_counts_table
from ..sources.sketches import write_sketches
from . import render
from .store import Index, Settings, load, same_settings


def _bounds(*bounds: select.Bounds | list[str] | None) -> tuple[select.Bounds | None, ...]:
    """Bounds by measure; texts without a name are for the number of shared words."""
    return tuple(select.parse_bounds(b) if isinstance(b, list) else b for b in bounds)


def all2all(
    index: Index,
    at_least: select.Bounds | list[str] | None = None,
    at_most: select.Bounds | list[str] | None = None,
    sample_rows: int | None = None,
    by: str | None = None,
    runs: bool = False,
) -> DataFrame:
    """(row_id, col_id, common, n_row, n_col) of pairs that share words and pass the bounds.

    ``sample_rows`` keeps that many partners of each sample: those with the highest ``by``, or random ones without it;
    pairs then appear from both sides. ``runs`` asks for an order in which tables of values take less room, where the plan
    has one at no cost of a shuffle.
    """
    k = index.settings.k
    at_least, at_most = _bounds(at_least, at_most)
    share, least = select.overlap_limits(k, at_least, at_most)
    if share >= overlap.WORTHWHILE_SHARE or least >= overlap.WORTHWHILE_WORDS:
        blocks, _ = overlap.grid_blocks(index.postings, index.most, overlap.GRID_PREFIX_PAIRS)
        if blocks:
            sized = grid.counted(index.postings, blocks, None, share, least, runs=runs)
        else:
            sized = overlap.all2all_sharing(index.postings, index.samples, share, least, most=index.most)
    else:
        best = sample_rows if by in (None, "jaccard") and not at_least and not at_most else None
        sized = overlap.all2all_sized(index.postings, index.samples, index.most, share, least, best, runs, None if by or best is None else 0)
    return _selected(sized, k, at_least, at_most, sample_rows, by)


def all2all_parts(indexes: list[Index], at_least=None, at_most=None, sample_rows: int | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, pairs) over partial indexes as if they were one."""
    settings = same_settings(*indexes)
    most = None if any(i.most is None for i in indexes) else sum(i.most for i in indexes)
    samples, post = overlap.one_of_parts([(i.samples, i.postings) for i in indexes])
    return samples, _selected(overlap.all2all_sized(post, samples, most), settings.k, at_least, at_most, sample_rows, by)


def _selected(sized, k, at_least, at_most, sample_rows, by) -> DataFrame:
    out = select.filtered(sized, k, *_bounds(at_least, at_most))
    if sample_rows is None:
        return out
    if by is None:
        return select.random_of_rows(out, sample_rows)
    return select.best_of_rows(select.scored(out, by, k, "_by"), sample_rows, "_by").drop("_by")


def load_listed(spark: SparkSession, path: str) -> list[Index]:
    """The stored indexes that a list file names, whitespace between them."""
    return [load(spark, p) for row in spark.read.text(path).collect() for p in row.value.split()]


def all2all_listed(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """``all2all_parts`` over the stored indexes that a list file names."""
    return all2all_parts(load_listed(spark, path), **options)


def new2all(queries: Index, index: Index, at_least=None, at_most=None) -> DataFrame:
    """(row_id, col_id, common, n_row, n_col) of new samples (rows) with those of an index; made with one settings."""
    k = same_settings(index, queries).k
    most = None if queries.most is None or index.most is None else queries.most * index.most
    pairs = overlap.new2all(queries.postings, index.postings, most=most)
    return select.filtered(select.with_sizes(pairs, queries.samples, index.samples), k, *_bounds(at_least, at_most))


def one2all(query: Index, index: Index) -> DataFrame:
    """(row_id, col_id, common, n_row, n_col) of one sample with every sample of an index, zeros included; no bounds apply."""
    same_settings(index, query)
    if query.samples.limit(2).count() != 1:
        raise ValueError("one2all takes one sample")
    one = query.samples.select(F.col("sample_id").alias("row_id"), F.col("n_kmers").alias("n_row"))
    found = overlap.one2all(query.postings, index.postings, index.samples).withColumnRenamed("sample_id", "col_id")
    sizes = index.samples.select(F.col("sample_id").alias("col_id"), F.col("n_kmers").alias("n_col"))
    return found.join(sizes, "col_id").crossJoin(F.broadcast(one)).select("row_id", "col_id", "common", "n_row", "n_col")


def sketch(samples: DataFrame, sequences: DataFrame, folder: str, settings: Settings | None = None) -> None:
    """Write a sketch file for each sample (sample_id, name). Without settings, words of 18 nucleotides, a hundredth of them.
    A sketch is of the lowest hashes; the settings' start of the range is not used."""
    s = settings or Settings(fraction=0.01)
    s.check()
    write_sketches(samples, extract.postings(sequences, s.k, s.letters, s.fraction), folder, s.k, s.fraction, s.letters)


def distances(sized: DataFrame, measure: str, k: int, at_least=None, at_most=None) -> DataFrame:
    """``value`` of one measure for each pair that passes the bounds."""
    return select.scored(select.filtered(sized, k, at_least, at_most), measure, k)


def distance_lines(table: CountsTable, measure: str, sparse: bool = False, phylip: bool = False, at_least=None, at_most=None) -> DataFrame:
    """(at, line) of a table of values, from a table of counts.

    A sparse table of counts gives a sparse one, as ``sparse`` does; only then are there bounds. Phylip tables are always
    dense. Of a lower triangle, row i has i values. Bounds are by measure; those given as texts (``"0.1"``, ``"mash:0.1"``)
    are for this measure if they name none.
    """
    at_least, at_most = (select.parse_bounds(b, measure) if isinstance(b, list) else b for b in (at_least, at_most))
    rows, columns, k = table.rows, table.columns, table.k
    if (sparse or table.sparse) and not phylip:
        values = distances(table.sized, measure, k, at_least, at_most)
        return render.values_lines(rows, columns, values, k, table.fraction, sparse=True)
    if measure in ZERO_APART:
        values, zeros = select.scored(table.sized, measure, k), "triangle" if table.triangular else "rectangle"
        return render.phylip_lines(rows, values, zeros) if phylip else render.values_lines(rows, columns, values, k, table.fraction, zeros=zeros)
    cells = overlap.cells(rows, columns, table.triangular).join(table.pairs, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("common", F.lit(0)).alias("common"))
    values = select.scored(select.with_sizes(cells, rows, columns), measure, k)
    return render.phylip_lines(rows, values) if phylip else render.values_lines(rows, columns, values, k, table.fraction)


def distance(spark: SparkSession, source: str, target: str, measure: str, compression: str = "none", **options) -> None:
    """Write a table of values to ``target`` from the table of counts at ``source``; either may be compressed, file by file."""
    render.write_lines(distance_lines(read_counts_table(spark, source), measure, **options), target, ordered=True, compression=compression)
