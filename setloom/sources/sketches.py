"""Sketch files: the words of one sample each, thinned by their hash.

A file holds a signature, the number of words, the words, k and the fraction. Words are stored as they are hashed, that is
short ones spread over 40 bits, in ascending order; in an index they aren't spread.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, alphabet
from .paths import qualified, with_file_number

#: First four bytes of a sketch file; fixed value.
SIGNATURE = 0xFEDCBA98
WORDS_AT_ONCE = 1 << 20
SUFFIX = ".minhash"


def _spread(k: int, bits: int) -> int:
    """How far the words of a file are shifted."""
    return max(0, 40 - k * bits)


def read_sketches(spark: SparkSession, paths: list[str], letters: Alphabet | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(samples, postings, {"k", "fraction"}) of sketch files of one alphabet; a path may leave out ``.minhash``.

    All files must agree on k and the fraction.
    """
    bits = (letters or alphabet()).bits
    full = [p if p.endswith(SUFFIX) else p + SUFFIX for p in paths]
    samples = spark.createDataFrame([(k, p.rsplit("/", 1)[-1].removesuffix(SUFFIX)) for k, p in enumerate(full)], "sample_id long, name string")
    files = spark.read.format("binaryFile").load(sorted({qualified(spark, p) for p in full})).select(F.col("_metadata.file_path").alias("path"), "content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer()
                signature, n = struct.unpack_from("<IQ", raw, 0)
                if signature != SIGNATURE:
                    raise ValueError(f"{path} is no sketch file")
                k, fraction = struct.unpack_from("<Id", raw, 12 + 8 * n)
                words = np.frombuffer(raw, "<i8", n, 12) >> _spread(k, bits)
                for at in range(0, max(n, 1), WORDS_AT_ONCE):
                    columns = [pa.array([path]), pa.array([k], pa.int32()), pa.array([fraction]), pa.array([words[at : at + WORDS_AT_ONCE]], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "k", "fraction", "kmers"])

    read = with_file_number(spark, files.mapInArrow(each, "path string, k int, fraction double, kmers array<long>"), "path", full)
    configs = read.select("k", "fraction").distinct().limit(2).collect()
    if len(configs) != 1:
        raise ValueError(f"sketches differ in k or fraction: {configs}")
    post = read.select(F.col("file_no").cast("long").alias("sample_id"), F.explode("kmers").alias("kmer")).distinct()
    return samples, post, configs[0].asDict()


def sketch_bytes(kmers: list[int], k: int, fraction: float, bits: int = 2) -> bytes:
    """The content of a sketch file."""
    by, words = _spread(k, bits), np.array(sorted(kmers), np.int64)
    stored = (words << by) | (words & ((1 << by) - 1))
    return struct.pack("<IQ", SIGNATURE, len(stored)) + stored.astype("<i8").tobytes() + struct.pack("<Id", k, fraction)


def write_sketches(samples: DataFrame, post: DataFrame, folder: str, k: int, fraction: float, letters: Alphabet | None = None) -> None:
    """Write a file a sample, ``<name>.minhash``, below ``folder``.

    A sample's sketch is one task's work: this is for small fractions. Samples of one name would be one file, and fail. The
    folder is written through Arrow's file systems.
    """
    spark, bits = samples.sparkSession, (letters or alphabet()).bits
    if samples.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("two samples have one name")
    target = qualified(spark, folder)
    target = f"file://{target.removeprefix('file:')}" if target.startswith("file:") else target
    lists = post.groupBy("sample_id").agg(F.collect_list("kmer").alias("kmers"))
    rows = samples.join(lists, "sample_id", "left").select("name", F.coalesce("kmers", F.array().cast("array<bigint>")).alias("kmers"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(target)
        store.create_dir(base)
        for b in batches:
            for name, kmers in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(sketch_bytes(kmers.as_py(), k, fraction, bits))
                store.move(part, f"{base}/{name}{SUFFIX}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(kmers)], pa.int64())], ["name", "n_kmers"])

    rows.mapInArrow(each, "name string, n_kmers long").write.format("noop").mode("overwrite").save()
