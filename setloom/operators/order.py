"""Numbers for rows in an order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, block: list[str], order: list[str], column: str) -> DataFrame:
    """``rows`` with numbers from 0 in the order of ``block``, then of ``order``.

    Only the blocks' counts are put in order in one task: a row for each split of a file, or each of a fixed number of
    buckets. Rows are put in order within their block.
    """
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy(*order))
    out = rows.withColumn("_place", place).join(F.broadcast(starts), block)
    return out.withColumn(column, (F.col("_start") + F.col("_place") - 1).cast("long")).drop("_start", "_place")


def numbered_names(names: DataFrame, column: str = "sample_id", buckets: int = 4096) -> DataFrame:
    """Of a table (name, ...) with one row a name: ids from 0, by a hash of the name, so that reruns agree."""
    return numbered(names.withColumn("_bucket", F.pmod(F.xxhash64("name"), F.lit(buckets))), ["_bucket"], ["name"], column).drop("_bucket")
