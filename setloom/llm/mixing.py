"""Mixing sources to target weights, to the word.

Every document gets a hash-random key, the MD5 of its id. Within a source documents are sorted by that key; because
keys are spread evenly, cutting the key range into equal pieces gives pieces of equal size, so one hot source is
sorted by many tasks. Prefix sums of sizes run within pieces and over the pieces' totals. A source takes all its
documents as many whole times as its target holds, then documents in key order up to the exact word at which the
target is reached.

Targets: the budget is ``share`` times all words, divided by weight; a source stops at ``cap`` times its own words
and the excess goes to the others by weight. With sources sorted by cap over weight this has a closed form, computed
with prefix sums over sources.

Defined results: null or blank texts have size 0 and nothing is taken of them. A null source is a source of its own,
last in order. Rows with one id and source share one key: at the cut they share what is left by size. Reruns give the
same result, on any number of tasks. Empty tables give empty results; columns that are not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle
from .text import n_words, or_empty

_BITS = 52


def mix_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))


def running_total(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """``df`` with, for each (name: column), the sum over all earlier rows in ``order``, and ``_row`` from 0.

    Rows are dealt by range; sums run within a range and then over the ranges' totals, of which there are as many as
    shuffle partitions.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = settle(ranged, "ranges")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_before_row", F.count(F.lit(1)).over(w))
    for name, column in values.items():
        out = out.withColumn(name, F.coalesce(F.sum(column).over(w), F.lit(0)))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_total_row"), *[F.sum(c).alias(f"_total_{n}") for n, c in values.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_from_{n}") for n in ["row", *values]])
    out = out.join(offsets, "_range").withColumn("_row", F.col("_before_row") + F.col("_from_row"))
    for name in values:
        out = out.withColumn(name, F.col(name) + F.col(f"_from_{name}"))
    return out.drop("_range", "_before_row", "_from_row", *[f"_from_{n}" for n in values])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of a table (source, source_size) with one row a source: the same with ``target``."""
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running_total(sizes, by_name, {}).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_row") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.drop("_row").withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    ranked = settle(ranked, "weights")
    total = ranked.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_all_weight")).withColumn("_budget", F.col("_all") * F.lit(share))
    summed = running_total(ranked, [F.col("_ratio"), *by_name], {"_caps": "_cap", "_weights": "_weight"}).crossJoin(F.broadcast(total))
    # the level of a source: words a unit of weight, if all before it are at their cap and it and all after it aren't
    summed = summed.withColumn("_level", (F.col("_budget") - F.col("_caps")) / (F.col("_all_weight") - F.col("_weights")))
    level = summed.agg(F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).getField("_level").alias("_final"))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")))
    return summed.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size) of each document, settled: texts are read once."""
    return settle(docs.select("doc_id", "source", mix_key(F.col("doc_id")).alias("_key"), n_words(or_empty(F.col("text"))).alias("size")), "sizes")


def cuts(rows: DataFrame, **options) -> DataFrame:
    """One row a source: how often all is taken, and the key at which the last round stops.

    A source of n rows has sqrt(n) pieces of about sqrt(n) rows, so neither sum runs over many rows in one task.
    Keys below ``_cut`` are taken once more; of the rows at ``_cut``, ``_left`` of ``_unit`` words are.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    per_source = settle(per_source.withColumn("_pieces", F.ceil(F.sqrt("_rows"))), "sources")
    targets = source_targets(per_source.select("source", "source_size"), **options)
    targets = targets.join(per_source.select(F.col("source").alias("_s"), "_pieces"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("_rounds", rounds.cast("long"))
    targets = targets.withColumn("_rest", F.floor(F.col("target") - F.col("_rounds") * F.col("source_size")).cast("long"))
    targets = settle(targets, "targets")
    units = rows.where("size > 0").groupBy("source", "_key").agg(F.sum("size").alias("_unit"))
    plan = targets.select(F.col("source").alias("_s"), "_pieces", "_rest")
    units = units.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    spread = F.conv(F.substring("_key", 1, _BITS // 4), 16, 10).cast("double") / F.lit(float(2**_BITS))
    units = units.withColumn("_piece", F.floor(spread * F.col("_pieces")))
    pieces = units.groupBy("source", "_piece").agg(F.sum("_unit").alias("_words"), F.first("_rest").alias("_rest"))
    over_pieces = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_start", F.coalesce(F.sum("_words").over(over_pieces), F.lit(0)))
    # only the piece in which the budget ends is sorted
    last = pieces.where((F.col("_start") <= F.col("_rest")) & (F.col("_start") + F.col("_words") > F.col("_rest")))
    last = last.select(F.col("source").alias("_s"), F.col("_piece").alias("_p"), "_start")
    inside = units.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    order = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_upto", F.col("_start") + F.coalesce(F.sum("_unit").over(order), F.lit(0)))
    at = inside.where((F.col("_upto") <= F.col("_rest")) & (F.col("_upto") + F.col("_unit") > F.col("_rest")))
    at = at.select(F.col("source").alias("_s"), F.col("_key").alias("_cut"), (F.col("_rest") - F.col("_upto")).alias("_left"), "_unit")
    out = targets.join(at, F.col("source").eqNullSafe(F.col("_s")), "left")
    return settle(out.select("source", "source_size", "target", "_rounds", "_cut", "_left", "_unit"), "cuts")


def with_taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, _key, size, ...) with source_size, target and taken."""
    last = (
        F.when(F.col("_key") < F.col("_cut"), F.col("size"))
        .when(F.col("_key") == F.col("_cut"), F.floor(F.col("size") * F.col("_left") / F.col("_unit")))
        .otherwise(F.lit(0))
    )
    joined = rows.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("taken", (F.col("size") * F.col("_rounds") + last).cast("long")).drop("_s", "_rounds", "_cut", "_left", "_unit")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken."""
    rows = sized(docs)
    return with_taken(rows, cuts(rows, **options)).drop("_key")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is begun. A document is never split: one of which the last
    round takes some words comes whole. Texts are not shuffled: the cut of the document's source decides."""
    cut = cuts(sized(docs), **options)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, "source", mix_key(F.col("doc_id")).alias("_key"), n_words(or_empty(F.col("text"))).alias("size"))
    taken = with_taken(rows, cut).withColumn("_copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)))
    return taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")
