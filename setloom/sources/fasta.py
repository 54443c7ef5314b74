"""FASTA files, plain or compressed, as sequences."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from .paths import exists, qualified, with_file_number, work_folder

#: Endings that a listed path may leave out, in the order in which they are tried.
SUFFIXES = ("", ".fa", ".fna", ".fasta", ".gz", ".fa.gz", ".fna.gz", ".fasta.gz")
#: Symbols of a stretch of a record, and of the stretches that a task hands over at once.
STRETCH, BATCH_SYMBOLS = 1 << 20, 1 << 22
_HEADS = "_found string, at long, record long, header string, symbols long, begin string, end string"


def resolve(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Each path with the first ending under which there is a file; an error if there is none."""
    out = []
    for path in paths:
        found = next((path + s for s in suffixes if exists(spark, path + s)), None)
        if found is None:
            raise FileNotFoundError(f"{path}, with any of the endings {suffixes}")
        out.append(found)
    return out


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths in a list file, or the path itself if it ends like a FASTA file."""
    if path.endswith(tuple(s for s in SUFFIXES if s and s != ".gz")):
        return [path]
    return [p for row in spark.read.text(path).collect() for p in row.value.split()]


def _in_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place in their split of a file. A task reads a split from its beginning to its end."""
    split, n = None, 0
    for b in batches:
        places = np.empty(b.num_rows, np.int64)
        for k, here in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            split, n = here, n + 1 if here == split else 0
            places[k] = n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places)], ["value", "_found", "at", "record"])


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, at, record, name, seq) of each record; ``at`` and ``record`` are its split of the file and its place in that.

    Files are read record by record: ``>`` ends one wherever it stands, and plain files are split among tasks. What stands
    before a file's first ``>`` is no record.
    """
    files = resolve(spark, paths)
    text = spark.read.option("lineSep", ">").text(sorted({qualified(spark, f) for f in files}))
    text = text.select("value", F.col("_metadata.file_path").alias("_found"), F.col("_metadata.file_block_start").alias("at")).mapInArrow(_in_splits, "value string, _found string, at long, record long")
    text = with_file_number(spark, text.where((F.col("at") > 0) | (F.col("record") > 0)).where(F.trim(F.translate("value", "\r\n", "")) != ""), "_found", files)
    header = F.regexp_replace(F.substring_index("value", "\n", 1), "\r", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return text.select("file_no", "at", "record", F.substring_index(header, " ", 1).alias("name"), F.translate(body, "\r\n", "").alias("seq"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], str | None, str]]:
    """((file, split, record), header, symbols) in the order of lines (value, file, split). Record 0 is what stands before a
    split's first ``>``; a record may come in several pieces, of which the first has its header."""
    split, n = None, 0
    for b in batches:
        lines = zip(*(c.to_pylist() for c in b.columns), strict=True)
        for here, rows in groupby(lines, key=lambda r: (r[1], r[2])):
            if here != split:
                split, n = here, 0
            body, *begun = "\n".join(r[0] for r in rows).replace("\r", "").split(">")
            yield (*split, n), None, body.replace("\n", "")
            for text in begun:
                n += 1
                header, _, body = text.partition("\n")
                yield (*split, n), header, body.replace("\n", "")


def _heads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What ``_HEADS`` names of each record of a split: its number of symbols there, the first and the last k - 1 of them."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in _HEADS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _HEADS.split(", ")])

    rows: list[tuple] = []
    for key, pieces in groupby(_texts(batches), key=lambda t: t[0]):
        header, n, begin, end = None, 0, "", ""
        for _, found, body in pieces:
            header, n = (header if found is None else found), n + len(body)
            begin = begin if len(begin) >= k - 1 else (begin + body)[: k - 1]
            end = (end + body)[max(0, len(end) + len(body) - k + 1) :]
        if n or header is not None:
            rows.append((*key, header, n, begin, end))
        if len(rows) >= 10_000:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def _stretches(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """(_found, at, record, seq): stretches of each record of a split, of which neighbours share k - 1 symbols."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["_found", "at", "record", "seq"])

    def rows_of() -> Iterator[tuple]:
        for key, pieces in groupby(_texts(batches), key=lambda t: t[0]):
            held = ""
            for _, _, body in pieces:
                held += body
                at = 0
                while len(held) - at >= size:
                    yield (*key, held[at : at + size])
                    at += size - k + 1
                held = held[at:]
            if len(held) >= k:
                yield (*key, held)

    rows, symbols = [], 0
    for row in rows_of():
        rows.append(row)
        symbols += len(row[3])
        if symbols >= BATCH_SYMBOLS or len(rows) >= 10_000:
            yield batch(rows)
            rows, symbols = [], 0
    if rows:
        yield batch(rows)


def _continued(heads: DataFrame, k: int) -> DataFrame:
    """What goes on in a split of a record that began in an earlier one: (_found, at, owner, bridge). ``owner`` is the split and
    place where it began; the bridge has its last k - 1 symbols before the split and its first k - 1 in it.

    Only a row a split is put in order, file by file.
    """
    ends = heads.groupBy("_found", "at").agg(F.max("record").alias("_n"), F.max_by("end", "record").alias("_end"))
    before = Window.partitionBy("_found").orderBy("at")
    began = F.when(F.col("_n") > 0, F.struct("at", F.col("_n").alias("record")))
    # every split here has a symbol or a header: the k - 1 before one reach back far enough
    near = F.collect_list(F.struct("_n", "_end")).over(before.rowsBetween(-max(1, k - 1), -1))
    carry = F.aggregate(near, F.lit(""), lambda acc, x: F.right(F.concat(F.when(x["_n"] > 0, F.lit("")).otherwise(acc), x["_end"]), F.lit(k - 1)))
    owner = F.last(began, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_found", "at", owner.alias("owner"), carry.alias("_carry")).where("owner is not null")
    return heads.where("record = 0").join(carried, ["_found", "at"]).select("_found", "at", "owner", F.concat("_carry", "begin").alias("bridge"))


def stretches(spark: SparkSession, paths: list[str], k: int, multisample: bool = False, size: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(samples, sequences) as ``read_fasta`` gives them, but of a record there are rows of ``size`` symbols at most, which share
    k - 1: they have the same words of length k, each as often, and a record of any length is read by as many tasks as its
    file has splits.

    Files are read by lines, so a line has to fit a value. Where a record goes on in the next split, a row of its own bridges
    both. Names and places are read first, and with ``multisample`` written to the shared folder; sequences are never put
    in order.
    """
    if size < k:
        raise ValueError(f"a stretch of {size} symbols has no word of {k}")
    files = resolve(spark, paths)
    lines = spark.read.option("lineSep", "\n").text(sorted({qualified(spark, f) for f in files}))
    lines = lines.select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    heads = lines.mapInArrow(partial(_heads, k=k), _HEADS)
    if multisample:
        path = f"{work_folder(spark)}/setloom/heads-{uuid.uuid4().hex}"
        heads.write.parquet(path)
        heads = spark.read.schema(_HEADS).parquet(path)
    found = lines.mapInArrow(partial(_stretches, k=k, size=size), "_found string, at long, record long, seq string")
    more = _continued(heads, k)
    if not multisample:
        names = [(n, f.rsplit("/", 1)[-1]) for n, f in enumerate(paths)]
        # what stands before a file's first record goes; a row a file
        first = heads.where("record > 0").groupBy("_found").agg(F.min("at").alias("_first"))
        found = found.join(F.broadcast(first), "_found").where((F.col("at") > F.col("_first")) | ((F.col("at") == F.col("_first")) & (F.col("record") > 0)))
        both = found.select("_found", "seq").unionAll(more.select("_found", F.col("bridge").alias("seq")))
        return spark.createDataFrame(names, "sample_id long, name string"), with_file_number(spark, both, "_found", files).select(F.col("file_no").cast("long").alias("sample_id"), "seq")
    keys = ["file_no", "at", "record"]
    begun = heads.where("record > 0")
    blank = (F.trim("header") == "") & (F.col("symbols") == 0)
    went_on = more.select("_found", "owner.*").distinct()
    kept = begun.where(~blank).unionAll(begun.where(blank).join(went_on, ["_found", "at", "record"], "left_semi").select(*begun.columns))
    kept = with_file_number(spark, kept.select("_found", "at", "record", F.substring_index("header", " ", 1).alias("name")), "_found", files)
    ids = numbered(kept.select(*keys, "name"), ["file_no", "at"], ["record"], "sample_id")
    more = with_file_number(spark, more, "_found", files).select("file_no", F.col("at").alias("_at"), "owner.*", "bridge")
    more = more.join(ids, keys).select("file_no", F.col("_at").alias("at"), F.lit(0).cast("long").alias("record"), "sample_id", "bridge")
    of = ids.select(*keys, "sample_id").unionAll(more.drop("bridge"))
    seqs = with_file_number(spark, found, "_found", files).join(of, keys).select("sample_id", "seq")
    return ids.select("sample_id", "name"), seqs.unionAll(more.select("sample_id", F.col("bridge").alias("seq")))


def read_fasta(spark: SparkSession, paths: list[str], multisample: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, sequences): samples (sample_id, name), sequences (sample_id, seq).

    One file is one sample, named after the file as listed; with ``multisample`` each record is, named by its header up to
    the first space. Ids follow the order of files and records. Names may repeat: ids tell samples apart. A file without a
    record is a sample without a word, or no sample with ``multisample``. A record is one value; ``stretches`` has no such bound.
    """
    found = records(spark, paths)
    if not multisample:
        names = [(k, f.rsplit("/", 1)[-1]) for k, f in enumerate(paths)]
        samples = spark.createDataFrame(names, "sample_id long, name string")
        return samples, found.select(F.col("file_no").cast("long").alias("sample_id"), "seq")
    keys = ["file_no", "at", "record"]
    # names and places are put in order, never sequences
    ids = numbered(found.select(*keys, "name"), ["file_no", "at"], ["record"], "sample_id")
    return ids.select("sample_id", "name"), found.join(ids.select(*keys, "sample_id"), keys).select("sample_id", "seq")
