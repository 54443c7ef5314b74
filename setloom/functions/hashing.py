"""The 64-bit hash by which words are thinned out, as JVM expressions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers of the 64-bit mix and of its finaliser, and the seed.
_MIX = (0x87C37B91114253D5, 0x4CF5AD432745937F)
_FINAL = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_SEED = 42
_TOP = -(1 << 63)


def signed(value: int) -> int:
    """The signed long of the same 64 bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


@contextmanager
def wrapping_arithmetic(spark: SparkSession) -> Iterator[None]:
    """Sums and products that are built here wrap around at 64 bits; they keep doing so later."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def padded(word: Column, k: int, bits: int) -> Column:
    """Short words are spread over 40 bits at least before they are hashed."""
    if k * bits >= 40:
        return word
    shift = 40 - k * bits
    return F.shiftleft(word, shift).bitwiseOR(word.bitwiseAND(F.lit((1 << shift) - 1).cast("long")))


def with_hash(df: DataFrame, word: str, k: int, bits: int, name: str = "hash") -> DataFrame:
    """``df`` with the hash of the packed words in column ``word``."""

    def const(value: int) -> Column:
        return F.lit(signed(value)).cast("long")

    def rotated(x: Column, by: int) -> Column:
        return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))

    length = -(-k // 4)
    with wrapping_arithmetic(df.sparkSession):
        out = df.withColumn("_u", padded(F.col(word).cast("long"), k, bits) * const(_MIX[0]))
        out = out.withColumn("_u", rotated(F.col("_u"), 31) * const(_MIX[1]))
        out = out.withColumn("_a", const(_SEED ^ length).bitwiseXOR(F.col("_u"))).withColumn("_b", const(_SEED ^ length))
        out = out.withColumn("_a", F.col("_a") + F.col("_b")).withColumn("_b", F.col("_b") + F.col("_a"))
        for lane in ("_a", "_b"):
            for factor in _FINAL:
                out = out.withColumn(lane, F.col(lane).bitwiseXOR(F.shiftrightunsigned(lane, 33)) * const(factor))
            out = out.withColumn(lane, F.col(lane).bitwiseXOR(F.shiftrightunsigned(lane, 33)))
        out = out.withColumn("_a", F.col("_a") + F.col("_b")).withColumn("_b", F.col("_b") + F.col("_a"))
        # a generator keeps the optimiser from writing the whole chain out again in a filter on the hash
        out = out.withColumn(name, F.explode(F.array(F.col("_a").bitwiseXOR(F.col("_b"))))).drop("_u", "_a", "_b")
        assert out.schema  # the plan is analysed while sums wrap
    return out


def thresholds(fraction: float, start: float = 0.0) -> tuple[int, int | None]:
    """The hashes that are kept: from the first, below the second (None: no bound)."""
    low, high = int(float(2**64) * start), int(float(2**64) * (start + fraction))
    return low, None if high >= 2**64 else high


def kept_by_hash(hash_: Column, fraction: float, start: float = 0.0) -> Column:
    """Whether a hash, read as unsigned, lies in [start, start + fraction) of the range. All are kept from fraction 1."""
    if fraction >= 1:
        return F.lit(True)
    low, high = thresholds(fraction, start)
    top = F.lit(_TOP).cast("long")
    key = hash_.bitwiseXOR(top)
    kept = key >= F.lit(signed(low) ^ _TOP).cast("long")
    return kept if high is None else kept & (key < F.lit(signed(high) ^ _TOP).cast("long"))
