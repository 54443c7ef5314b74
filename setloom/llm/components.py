"""Connected components over edges, by hash-to-min rounds with pointer jumping, in joins and aggregates.

Each round is a large-star and a small-star step: neighbours are re-linked to the smallest node they know of, which
shortens paths to logarithmic depth without giving any node more edges. Rounds are settled in the shared folder, and
only two counts reach the driver. Hubs are safe: minima are aggregated before the shuffle, and the join that hands a
minimum out deals the edges of a hot node to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import salted_join
from .store import settle


def _with_least(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``pairs`` (node, other) with the ``least`` of their node."""
    return salted_join(pairs, least, "node", "_n", F.col("other"), "inner", total).drop("_n", "_salt", "_salts")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    pairs = pairs.unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"), F.count(F.lit(1)).alias("_n"))
    met = _with_least(pairs.where("other > node"), least, 2 * n)
    return met.select(F.col("other").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = down.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("_n"))
    moved = _with_least(down, least, n).where("other <> least").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, n = None, now.count()
    for _ in range(max_rounds):
        now = settle(_small_star(settle(_large_star(now, n), "stars"), n), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, n = seen, seen[0]
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    # settled: every edge points from a node to its component
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.withColumn("component", F.col("node")))
