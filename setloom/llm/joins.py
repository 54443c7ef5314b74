"""Joins in which no key is hot, and a filter that keeps rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with over this share of all rows, so at most as many are, and with over ``LEAST_ROWS`` rows.
HOT_SHARE = 1 << 16
LEAST_ROWS = 16
#: Bits of a filter for each id: at one bit an id, a sixteenth of other rows pass at most.
BITS_PER_ID = 16
#: A broadcast filter has 64 MB at most: from 33 million ids on it lets more other rows pass, two thirds at 600 million.
MAX_BITS = 1 << 29
_BITMAP_BITS = 32768


def salted_join(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column, how: str = "inner", total: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, in which ``weight`` says how many of ``rows`` have a row's key.

    Rows of a hot key are dealt to as many salts as it takes for each to hold about a 65536th of all rows, or 16; the table's
    rows are repeated once a salt. ``spread`` tells a key's rows apart. ``_salt`` and ``_salts`` stay in the result. ``total`` is
    the number of all rows (left out: the sum of the weights). The weights are read twice. If the table has several rows a
    key, or no weights, they are given apart as ``weights`` (key, weight), one row a key.
    """
    counted = table if weights is None else weights
    if total is None:
        total = counted.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    salts = F.greatest(F.ceil(F.col(weight) / F.lit(max(LEAST_ROWS, -(-total // HOT_SHARE)))), F.lit(1)).cast("int")
    salted = counted.withColumn("_salts", salts)
    hot = F.broadcast(salted.where("_salts > 1").select(F.col(key).alias("_hot_key"), F.col("_salts").alias("_hot")))  # at most HOT_SHARE rows
    mine = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    mine = mine.withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_hot", F.lit(1))).cast("int")).drop("_hot_key", "_hot")
    if weights is None:
        keyed = salted
    else:
        keyed = table.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn("_salts", F.coalesce("_hot", F.lit(1))).drop("_hot_key", "_hot")
    return mine.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))), [key, "_salt"], how)


def filter_bits(n: int) -> int:
    """Bits of a filter of ``n`` ids: a power of two, at least ``BITS_PER_ID`` an id."""
    return max(_BITMAP_BITS, 1 << (BITS_PER_ID * max(1, n) - 1).bit_length())


def _slot(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def bitmaps(ids: DataFrame, column: str, bits: int) -> DataFrame:
    """(_bucket, _bitmap): a row for each 4 KB of the filter that is not all zero."""
    slot = ids.select(_slot(F.col(column), bits).alias("slot"))
    return slot.groupBy((F.col("slot") / _BITMAP_BITS).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg((F.col("slot") % _BITMAP_BITS).cast("long")).alias("_bitmap"))


def marked(rows: DataFrame, maps: DataFrame, value: Column, bits: int) -> DataFrame:
    """``rows`` with ``_maybe``: false only where the filter rules the value out. The join is on the bucket."""
    slot = _slot(value, bits)
    at = (slot % _BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", (slot / _BITMAP_BITS).cast("int")).join(maps, "_bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_bucket", "_bitmap")


def maybe_among(rows: DataFrame, value: Column, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``value`` is surely none of ``ids``.

    The filter is broadcast; its size follows the number of ids, up to ``MAX_BITS``. Beyond, the same plan holds and the
    filter rules out fewer rows.
    """
    bits = min(filter_bits(ids.count()), MAX_BITS)
    return marked(rows, F.broadcast(bitmaps(ids, column, bits)), value, bits)
