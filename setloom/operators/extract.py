"""From sequences to postings: the distinct words of each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from ..functions.hashing import kept_by_hash, with_hash


def words(sequences: DataFrame, k: int, letters: Alphabet, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    """(sample, word) with repeats; words are strings of symbols, the lesser of both strands where strands are one.

    No word crosses an invalid symbol or the end of a row. Stretches of valid symbols are sliced as bytes, so a slice's
    cost does not grow with its place in the stretch.
    """
    letters.check_k(k)
    runs = sequences.select(sample, F.explode(F.split(letters.mapped(F.col(seq)), f"[^{letters.symbols}]+")).alias("_run"))
    runs = runs.where(F.length("_run") >= k).select(sample, F.col("_run").cast("binary").alias("_bytes"))
    at = F.explode(F.sequence(F.lit(1), F.length("_bytes") - (k - 1)))
    out = runs.select(sample, "_bytes", at.alias("_at")).select(sample, F.substring("_bytes", F.col("_at"), F.lit(k)).cast("string").alias("word"))
    return out.select(sample, F.least("word", letters.reverse_complement(F.col("word"))).alias("word")) if letters.canonical else out


def postings(
    sequences: DataFrame, k: int, letters: Alphabet, fraction: float = 1.0, fraction_start: float = 0.0, sample: str = "sample_id", seq: str = "seq"
) -> DataFrame:
    """(sample_id, kmer): the distinct words of each sample as packed numbers, thinned before they are shuffled."""
    packed = words(sequences, k, letters, sample, seq).select(F.col(sample).alias("sample_id"), letters.packed(F.col("word")).alias("kmer"))
    return sketched(packed, k, letters.bits, fraction, fraction_start).distinct()


def sketched(kmers: DataFrame, k: int, bits: int, fraction: float, fraction_start: float = 0.0) -> DataFrame:
    """The rows whose word's hash lies in the given part of the range."""
    if fraction >= 1:
        return kmers
    columns = kmers.columns
    return with_hash(kmers, "kmer", k, bits, "_hash").where(kept_by_hash(F.col("_hash"), fraction, fraction_start)).select(*columns)


def cardinalities(post: DataFrame, samples: DataFrame) -> DataFrame:
    """``samples`` (sample_id, ...) with n_kmers, 0 for those without a word."""
    counts = post.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_kmers"))
    kept = [c for c in samples.columns if c != "n_kmers"]
    return samples.select(*kept).join(counts, "sample_id", "left").select(*kept, F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"))


def item_sets(table: DataFrame, sample: str, item: str) -> DataFrame:
    """Postings from ready-made items: any (sample, number) table."""
    return table.select(F.col(sample).alias("sample_id"), F.col(item).cast("long").alias("kmer")).where("sample_id is not null and kmer is not null").distinct()


def counted_words(table: DataFrame, sample: str, kmer: str, count: str, low: int = 1, high: int | None = None) -> DataFrame:
    """Postings from words with counts: those whose count lies within the bounds."""
    inside = (F.col(count) >= low) if high is None else F.col(count).between(low, high)
    return item_sets(table.where(inside), sample, kmer)
