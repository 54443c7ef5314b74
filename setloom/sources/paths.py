"""Paths and folders, through Hadoop's file systems."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and has its executors on one machine.
LOCAL_DEFAULT = "/tmp/checkpoints"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _hadoop(spark, path)
    return store.exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, unescaped."""
    store, target = _hadoop(spark, path)
    return store.makeQualified(target).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    store, target = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(target)) if store.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it."""
    store, target = _hadoop(spark, path)
    store.delete(target, True)


def aged(spark: SparkSession, path: str) -> float:
    """Seconds since anything in a folder, or in its folders, was written."""
    store, target = _hadoop(spark, path)
    times = [store.getFileStatus(target).getModificationTime(), *(f.getModificationTime() for f in store.listStatus(target))]
    return time.time() - max(times) / 1000


def text_of(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    store, target = _hadoop(spark, path)
    size, stream = store.getFileStatus(target).getLen(), store.open(target)
    try:
        return bytes(stream.readNBytes(size)).decode("utf-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one: then False. It is moved to its place by a rename that overwrites nothing."""
    store, target = _hadoop(spark, path)
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = store.create(part, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        whole = [store.makeQualified(p) for p in (part, target)]
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole[1].toUri(), context).rename(*whole, options)
        return True
    except Py4JJavaError as error:
        store.delete(part, False)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for what is written on the way."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (base or LOCAL_DEFAULT).rstrip("/")


def _plain(url: Column) -> Column:
    """A file's URL as a path: unescaped, with one slash after the scheme."""
    return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^([A-Za-z][A-Za-z0-9+.\\-]*):/+", "$1:/")


def with_file_number(spark: SparkSession, rows: DataFrame, url: str, paths: list[str]) -> DataFrame:
    """``rows`` with file_no, the place in ``paths`` of the file that a row's ``url`` names. A file that is listed twice has
    its rows twice; a row of a file that isn't listed is an error."""
    numbers = spark.createDataFrame([(k, qualified(spark, p)) for k, p in enumerate(paths)], "file_no int, _path string")
    numbers = numbers.withColumn("_path", F.regexp_replace("_path", "^([A-Za-z][A-Za-z0-9+.\\-]*):/+", "$1:/"))
    found = rows.withColumn("_path", _plain(F.col(url))).join(F.broadcast(numbers), "_path", "left")
    known = F.when(F.col("file_no").isNull(), F.raise_error(F.concat(F.lit("no listed file is "), F.col("_path"))).cast("int")).otherwise(F.col("file_no"))
    return found.withColumn("file_no", known).drop("_path")
