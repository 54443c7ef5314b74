"""Exact deduplication with a log-structured merge index of digests.

Documents go to the index in batches. A memtable is what a task aggregates of its batch: one entry a digest. It is
flushed as a run: a Parquet table sorted by digest, and a filter, a bitmap of the run's digests. When a batch is flushed
its digests are probed in all earlier runs: only those that pass a run's filter are looked up in it. A digest that was
there before, or that the batch has more than once, is a hit. When a level has ``FAN_IN`` runs they are compacted into one
of the next level: of equal digests it keeps the identifier that stays and adds the counts. A manifest, written last,
names the runs, so an index can be opened again, and a flush that fails leaves it as it was.

Hits are looked up in the runs, and verified byte by byte against the text of the row that stays. To fetch the hits'
texts, a second scan passes a filter, so that other texts aren't shuffled. Hot digests are salted before their rows, texts
or not, are shuffled, and the row that they meet is repeated once a salt.

Everything is DataFrame expressions; no Python runs on executors.

Defined results: texts are equal when identical after lower-casing A-Z only; null counts as empty. The row with the
largest (or smallest) doc_id of a group stays. Rows that repeat a doc_id with an equal text are rows of one group: all
of them have ``kept`` true if theirs is the id that stays. A null doc_id sorts below all others. A row whose digest is in
the index but whose bytes differ from the kept text (a collision) is grouped by its text. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import bitmaps, filter_bits, marked, maybe_among, salted_join
from .store import settle, shared_folder
from .text import ascii_lower, or_empty

#: Batches that a whole table is fed to the index in.
BATCHES = 4
#: Runs of a level from which they are compacted.
FAN_IN = 4
#: Digests that one file of a run holds, about.
FILE_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return ascii_lower(or_empty(text))


def digest_of(text: Column) -> Column:
    """The SHA-256 of a text that isn't null. It is never null, and is said so: else joins test it on every row first."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


class DigestIndex:
    """A log-structured merge index from digest to (keep_id, n) below ``path``; what is there already is opened."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "max", fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.pick = F.max if keep == "max" else F.min
        #: Of each level, its runs: name and number of entries.
        self.levels: list[list[tuple[str, int]]] = [[]]
        self._version = max(self._versions(), default=0)
        self._kind = "long"
        if self._version:
            self._kind, levels = json.loads(spark.read.text(f"{path}/manifest/{self._version:08}").first().value)
            self.levels = [[(name, n) for name, n in level] for level in levels]

    def _versions(self) -> list[int]:
        """Versions of the manifest that are complete."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = jvm.Path(f"{self.path}/manifest/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return [int(f.getPath().getParent().getName()) for f in found or []]

    def _commit(self, levels: list[list[tuple[str, int]]]) -> None:
        self._version += 1
        line = self.spark.createDataFrame([(json.dumps([self._kind, levels]),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self._version:08}")
        self.levels = levels

    def _entries(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"digest binary, keep_id {self._kind}, n long").parquet(f"{self.path}/{name}/entries")

    def _run(self, entries: DataFrame, most: int) -> tuple[str, int]:
        """Write a run of ``most`` entries at most, sorted by digest over all its files, and its filter."""
        name = f"run-{uuid.uuid4().hex}"
        entries.repartitionByRange(max(1, -(-most // FILE_ROWS)), "digest").sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}/entries")
        n = self._entries(name).count()
        bitmaps(self._entries(name), "digest", filter_bits(n)).write.parquet(f"{self.path}/{name}/filter")
        return name, n

    def _probed(self, entries: DataFrame, run: tuple[str, int]) -> DataFrame:
        """(digest) of ``entries`` that are in a run. What its filter rules out isn't looked up in it."""
        name, n = run
        maps = self.spark.read.schema("_bucket int, _bitmap binary").parquet(f"{self.path}/{name}/filter")
        maybe = marked(entries.select("digest"), maps, F.col("digest"), filter_bits(n)).where("_maybe").select("digest")
        return maybe.join(self._entries(name).select("digest"), "digest", "left_semi")

    def flush(self, batch: DataFrame, rows: int) -> DataFrame:
        """Add a batch (doc_id, digest) of ``rows`` rows at most as one run; returns its hits (digest), settled."""
        self._kind = batch.schema["doc_id"].dataType.simpleString()
        earlier = [run for level in self.levels for run in level]
        entries = batch.groupBy("digest").agg(self.pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        name, n = self._run(entries, rows)
        written = self._entries(name)
        hits = settle(reduce(DataFrame.unionAll, [written.where("n > 1").select("digest"), *(self._probed(written, r) for r in earlier)]).distinct(), "hits")
        levels = [[*level] for level in self.levels]
        levels[0].append((name, n))
        for k, level in enumerate(levels):
            if len(level) >= self.fan_in:
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(self._merged(level))
                levels[k] = []
        self._commit(levels)
        return hits

    def _merged(self, runs: list[tuple[str, int]]) -> tuple[str, int]:
        entries = reduce(DataFrame.unionAll, [self._entries(name) for name, _ in runs])
        return self._run(entries.groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n")), sum(n for _, n in runs))

    def compact(self) -> DataFrame:
        """Merge all runs into one and return its entries."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            raise ValueError("nothing was flushed to this index")
        if len(runs) > 1:
            self._commit([[] for _ in self.levels[1:]] + [[self._merged(runs)]])
        return self._entries(self.levels[-1][0][0])

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of those of ``digests`` (one row each) that are in the index."""
        found = [self._entries(name).join(digests, "digest", "left_semi") for level in self.levels for name, _ in level]
        return reduce(DataFrame.unionAll, found).groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, keep: str = "max", batches: int = BATCHES) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    digest = digest_of(normalised(F.col("text")))
    log = settle(docs.select("doc_id", digest.alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("_batch")), "log", by="_batch")
    rows, index = log.count(), DigestIndex(spark, shared_folder(spark, "index"), keep)
    found = [index.flush(log.where(F.col("_batch") == b).select("doc_id", "digest"), rows) for b in range(batches)]
    hits = settle(index.lookup(reduce(DataFrame.unionAll, found).distinct()), "hits")
    groups = salted_join(log.select("doc_id", "digest"), hits, "digest", "n", F.col("doc_id"), "left", rows)
    groups = settle(groups.select("doc_id", "digest", "keep_id", "n"), "groups")
    differ = _differing(docs, groups.where("n is not null"), hits, rows)
    alone = F.col("n").isNull()
    out = groups.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    if differ is not None:
        out = _regrouped(out, differ, keep)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _differing(docs: DataFrame, ids: DataFrame, hits: DataFrame, rows: int) -> DataFrame | None:
    """Hits whose bytes aren't those of the row that stays: (doc_id, digest, text). None if there are none."""
    texts = maybe_among(docs.select("doc_id", "text"), F.col("doc_id"), ids, "doc_id").where("_maybe").select("doc_id", normalised(F.col("text")).alias("_text"))
    texts = texts.withColumn("digest", digest_of(F.col("_text")))
    met = salted_join(texts, hits, "digest", "n", F.col("doc_id"), "inner", rows)
    # of rows that repeat the id that stays, one is the text to compare with
    # a filter on the ids would become a key of the join above, and texts would be shuffled again for it
    stays = F.when(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.col("_text"))
    first = met.groupBy("digest").agg(F.min(stays).alias("_kept_text"), F.first("_salts").alias("_salts"))
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    bad = met.join(first, ["digest", "_salt"]).where(F.col("_text") != F.col("_kept_text")).select("doc_id", "digest", "_text")
    bad = settle(bad, "collisions")
    return None if bad.isEmpty() else bad


def _regrouped(out: DataFrame, differ: DataFrame, keep: str) -> DataFrame:
    """Take the colliding rows out of their digest's group and group them by text."""
    pick = F.max if keep == "max" else F.min
    own = differ.groupBy("digest", "_text").agg(pick("doc_id").alias("_own_keep"), F.count(F.lit(1)).alias("_own_n"))
    rows = differ.join(own, ["digest", "_text"]).select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "_own_keep", "_own_n").distinct()
    fewer = differ.groupBy(F.lower(F.hex("digest")).alias("text_sha256")).agg(F.count(F.lit(1)).alias("_gone"))
    out = out.join(rows, ["doc_id", "text_sha256"], "left").join(fewer, "text_sha256", "left")
    size = F.coalesce("_own_n", F.col("group_size") - F.coalesce("_gone", F.lit(0)))
    return out.select("doc_id", F.coalesce("_own_keep", "keep_id").alias("keep_id"), size.alias("group_size"), "text_sha256")


def kept_documents(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One document of each group of equal texts, with its columns. Rows that repeat the id that stays count as one, the
    least as JSON. Only texts that may belong to a group of several rows are shuffled.
    """
    groups = dedup(docs, keep).where("group_size > 1").groupBy(F.col("doc_id").alias("_of"), F.unhex("text_sha256").alias("_hash"), "kept")
    groups = settle(groups.agg(F.count(F.lit(1)).alias("_rows")), "groups")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    flagged = maybe_among(docs.select(whole, F.col("doc_id").alias("_id")), F.col("_id"), groups, "_of")
    alone = flagged.where("not _maybe").select("_doc.*")
    maybe = flagged.where("_maybe").withColumn("_digest", digest_of(normalised(F.col("_doc.text"))))
    maybe = maybe.join(groups, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_digest") == F.col("_hash")), "left")
    single = maybe.where("kept is null or kept and _rows = 1").select("_doc.*")
    several = maybe.where("kept and _rows > 1").groupBy("_id", "_digest").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*")
    return alone.unionAll(single).unionAll(several)
