"""Intermediate tables in the folder that the whole cluster shares.

The folder is ``spark.checkpoint.dir``. Executors may be lost at any time, so whatever cuts lineage here is a
Parquet table in that folder: it outlives the tasks that wrote it. Every call gets a folder of its own. A result reads
such tables when it is computed, so they can't be deleted before that: ``discard`` deletes all that a session has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.paths import work_folder

#: A name for the folders of this session.
_RUN = uuid.uuid4().hex


def shared_base(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/setloom/{_RUN}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later reads don't recompute it.

    With ``by``, an integer column, there is a folder for each of its values, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete this session's tables, through Hadoop's file system, once results that read them are computed."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
