"""One entry for all sources of samples."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.extract import cardinalities
from ..operators.order import numbered_names
from ..plans.store import Index, Settings, build, from_words
from .fasta import listed, stretches
from .sketches import read_sketches

FORMATS = ("fasta", "multisample-fasta", "sketch", "words")


def read_samples(spark: SparkSession, path: str, settings: Settings, format: str = "fasta") -> Index:
    """An index of the samples that the list file ``path`` names, whitespace between them; a path with the ending of a FASTA
    file is the one sample itself.

    ``sketch``: files of words that were thinned already; k and the fraction come from them, and must be the settings' if the
    index is to be compared with others. ``words``: ``path`` is a Parquet table (name, kmer) of packed words; a row without a
    word names a sample that may have none.
    """
    if format in ("fasta", "multisample-fasta"):
        return build(*stretches(spark, listed(spark, path), settings.k, format == "multisample-fasta"), settings)
    if format == "sketch":
        samples, post, found = read_sketches(spark, listed(spark, path), settings.letters)
        own = Settings(found["k"], settings.alphabet, settings.preserve_strand, found["fraction"], settings.fraction_start)
        return Index(cardinalities(post, samples), post, own)
    if format == "words":
        table = spark.read.parquet(path)
        ids = numbered_names(table.select("name").distinct())
        return from_words(ids, table.where("kmer is not null").join(ids, "name").select("sample_id", "kmer"), settings)
    raise ValueError(f"unknown format {format!r}; there are {', '.join(FORMATS)}")
