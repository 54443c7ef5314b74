"""Scores of pairs, filters on them, and the best or a random few of each row."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import MEASURES, least_share, measure
from .grid import may_be_best

Bounds = Mapping[str, float]

#: Rows of a task from which those that are surely not chosen are sorted out.
POOL = 1 << 20


def parse_bounds(texts: list[str], default: str = "num-kmers") -> dict[str, float]:
    """``["jaccard:0.1", "20"]`` as bounds by measure; one without a name is for ``default``; the last of a name holds."""
    out: dict[str, float] = {}
    for text in texts:
        name, _, value = text.rpartition(":")
        name = name or default
        if name not in MEASURES:
            raise ValueError(f"unknown measure {name!r}")
        out[name] = round(float(value)) if name == "num-kmers" else float(value)
    return out


def with_sizes(pairs: DataFrame, rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """``pairs`` with n_row and n_col, the sizes of both samples."""
    columns = rows if columns is None else columns
    a = rows.select(F.col("sample_id").alias("row_id"), F.col("n_kmers").alias("n_row"))
    b = columns.select(F.col("sample_id").alias("col_id"), F.col("n_kmers").alias("n_col"))
    return pairs.join(a, "row_id").join(b, "col_id")


def scored(sized: DataFrame, name: str, k: int, column: str = "value") -> DataFrame:
    return sized.withColumn(column, measure(name, F.col("common"), F.col("n_row"), F.col("n_col"), k))


def filtered(sized: DataFrame, k: int, at_least: Bounds | None = None, at_most: Bounds | None = None) -> DataFrame:
    """Pairs whose measures all lie within their bounds, inclusive. Bounds are compared with unrounded values."""
    out = sized
    for bounds, keep in ((at_least or {}, lambda v, x: v >= x), (at_most or {}, lambda v, x: v <= x)):
        for name, bound in bounds.items():
            value = measure(name, F.col("common"), F.col("n_row"), F.col("n_col"), k)
            out = out.where(keep(value, F.lit(float(round(bound) if name == "num-kmers" else bound))))
    return out


def overlap_limits(k: int, at_least: Bounds | None, at_most: Bounds | None = None) -> tuple[float, int]:
    """What bounds ask of the words that a pair shares: at least this part of the larger set, and this many."""
    shares = [least_share(name, bound, k) for name, bound in (at_least or {}).items()]
    shares += [least_share(name, bound, k, True) for name, bound in (at_most or {}).items()]
    return max(shares, default=0.0), int(round((at_least or {}).get("num-kmers", 0)))


def both_ways(sized: DataFrame) -> DataFrame:
    """Each pair from both of its samples. Measures keep the first orientation: ``value`` isn't worked out anew."""
    turned = sized.select(*[F.col({"row_id": "col_id", "col_id": "row_id"}.get(c, c)).alias(c) for c in sized.columns])
    return sized.unionByName(turned)


def best_of_rows(pairs: DataFrame, n: int, value: str = "value") -> DataFrame:
    """For each sample, its n partners of highest value; of equal ones, those of smaller id. The result isn't triangular."""
    order = Window.partitionBy("row_id").orderBy(F.col(value).desc(), F.col("col_id").asc())
    return both_ways(pairs).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def _may_be_chosen(rows: DataFrame, n: int, column: str, pool: int) -> DataFrame:
    """``rows`` without those that ``n`` others of their row_id, in the same task, precede by ``column`` (0 to 2^52). Tasks sort
    out what they hold, a bounded number of rows, so that few leave them; no row that is chosen of all is lost."""
    at = rows.columns.index(column)

    def kept(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        t = t.take(pa.array(np.argsort(t.column("row_id").to_numpy(), kind="stable")))
        value = (1 << 52) - t.column(at).to_numpy()
        return t.filter(pa.array(may_be_best(t.column("row_id").to_numpy(), value.astype(np.float64), n))).combine_chunks()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= pool:
                left = kept(held)
                held, size = left.to_batches(), left.num_rows
                if 2 * size > pool:  # too many rows to hold: others decide
                    yield from held
                    held, size = [], 0
        if size:
            yield from kept(held).to_batches()

    return rows.mapInArrow(each, rows.schema)


def random_of_rows(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """For each sample, n of its partners, chosen evenly by a seeded hash: reruns agree. Of all pairs, those that may be chosen
    are found task by task; only these are shuffled and sorted."""
    sides = [F.struct(*[F.col({"row_id": b, "col_id": a}.get(c, c)).alias(c) for c in pairs.columns]) for a, b in (("col_id", "row_id"), ("row_id", "col_id"))]
    mark = F.md5(F.concat_ws(",", "row_id", "col_id", F.lit(seed)))
    turned = pairs.select(F.explode(F.array(*sides)).alias("_pair")).select("_pair.*")
    early = _may_be_chosen(turned.withColumn("_early", F.conv(F.substring(mark, 1, 13), 16, 10).cast("long")), n, "_early", POOL)
    order = Window.partitionBy("row_id").orderBy(mark, F.col("col_id"))
    return early.drop("_early").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")
