"""Growing a stored index from a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import FAN, compact, merge


def add_batch(batch: DataFrame, number: int, path: str, stream: str = "stream", name: str = "name", seq: str = "seq") -> None:
    """Add the rows (name, seq) of a micro-batch to the index at ``path``; all rows of a name are one sample, whatever batches
    they come in.

    The index remembers the last batch of each stream. A batch is complete or isn't there, so one that is run again after a
    failure is added once. Parts of batches are merged as they become many.
    """
    merge(batch.sparkSession, path, batch.select(F.col(name).alias("name"), F.col(seq).alias("seq")), (stream, number))
    compact(batch.sparkSession, path, FAN)


def extend_from_stream(
    stream: DataFrame, path: str, checkpoint: str, name: str = "name", seq: str = "seq", trigger: dict | None = None, stream_name: str = "stream"
) -> StreamingQuery:
    """Add each micro-batch of (name, seq) to the index at ``path``. Streams that feed one index need names of their own;
    they may run at once."""

    def grow(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path, stream_name, name, seq)

    writer = stream.writeStream.foreachBatch(grow).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
