"""The index in storage: postings, samples and settings; building, extending, compacting and reading it.

A stored index is a folder of immutable parts and of versions. A part holds some samples, with ids from 0, and their
postings, bucketed by word into as many buckets as the index has. A version is a line of JSON that names its parts, the id
at which each begins, and the last batch of each stream. A change writes its parts first and then the next version, which is
moved to its place only if nobody else was faster; otherwise the change is made again upon the version that won, for which
no part is rewritten, as a part's ids are relative. So readers see whole versions, and writers may run at once.
``merge`` adds words to samples that are there, by name: its part begins at id 0 and holds only words that its samples lack.

Postings of a version are one bucketed table whose partitions are the parts, in the session's catalog: a join or an
aggregation by word reads it as it lies, without an exchange. A word's bucket is the same in every part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, alphabet
from ..operators.extract import cardinalities, postings, sketched
from ..operators.order import numbered_names
from ..sources.paths import aged, children, delete, put_new, qualified, text_of

#: Adjacent parts of about one size that are merged into one, and the rows up to which parts count as of the least size.
FAN, LEAST_ROWS = 8, 1 << 20
SAMPLES, POSTINGS = "sample_id long, name string, n_kmers long", "sample_id long, kmer long"


@dataclass(frozen=True)
class Settings:
    """What a word is in an index, and which part of the words it holds."""

    k: int = 18
    alphabet: str = "nt"
    preserve_strand: bool = False
    fraction: float = 1.0
    fraction_start: float = 0.0

    @property
    def letters(self) -> Alphabet:
        return alphabet(self.alphabet, self.preserve_strand)

    def check(self) -> None:
        self.letters.check_k(self.k)
        if not 0 < self.fraction <= 1 or not 0 <= self.fraction_start < 1:
            raise ValueError(f"fraction {self.fraction} from {self.fraction_start} is no part of the words")


@dataclass
class Index:
    """An index: samples (sample_id, name, n_kmers), postings (sample_id, kmer), settings.

    ``most``, where it is known, is a number of samples that no word exceeds.
    """

    samples: DataFrame
    postings: DataFrame
    settings: Settings
    most: int | None = None

    def stats(self) -> DataFrame:
        """One row: samples, distinct words, distinct patterns, k and fraction.

        The samples of a word are told apart by their number and 128 bits of hash, so no list of them is made.
        """
        marks = [F.bit_xor(F.xxhash64("sample_id", F.lit(seed))).alias(f"_x{seed}") for seed in (1, 2)]
        words = self.postings.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"), *marks)
        kinds = words.groupBy("_n", "_x1", "_x2").agg(F.count(F.lit(1)).alias("_words"))
        both = kinds.agg(F.coalesce(F.sum("_words"), F.lit(0)).alias("n_kmers"), F.count(F.lit(1)).alias("n_patterns"))
        count = self.samples.agg(F.count(F.lit(1)).alias("n_samples"))
        return count.crossJoin(both).select("*", F.lit(self.settings.k).alias("k"), F.lit(self.settings.fraction).alias("fraction"))


def build(samples: DataFrame, sequences: DataFrame, settings: Settings) -> Index:
    """An index of sequences (sample_id, seq); a sample without a word is kept, with 0."""
    settings.check()
    post = postings(sequences, settings.k, settings.letters, settings.fraction, settings.fraction_start)
    return Index(cardinalities(post, samples), post, settings)


def from_words(samples: DataFrame, words: DataFrame, settings: Settings) -> Index:
    """An index of words (sample_id, kmer) that were counted elsewhere; repeats count once, and they are thinned here."""
    settings.check()
    post = sketched(words.select("sample_id", "kmer"), settings.k, settings.letters.bits, settings.fraction, settings.fraction_start).distinct()
    return Index(cardinalities(post, samples), post, settings)


def extended(index: Index, samples: DataFrame, sequences: DataFrame) -> Index:
    """``index`` with more samples, whose ids follow those it has. Words are made as the index's settings say."""
    offset = F.lit((index.samples.agg(F.max("sample_id")).first()[0] + 1) if not index.samples.isEmpty() else 0)
    more = build(samples.withColumn("sample_id", F.col("sample_id") + offset), sequences.withColumn("sample_id", F.col("sample_id") + offset), index.settings)
    return Index(index.samples.unionByName(more.samples), index.postings.unionByName(more.postings), index.settings)


def same_settings(*indexes: Index) -> Settings:
    """The settings that all of some indexes have; an error if they differ."""
    found: list[dict[str, Any]] = []
    for index in indexes:
        if asdict(index.settings) not in found:
            found.append(asdict(index.settings))
    if len(found) != 1:
        raise ValueError(f"indexes differ in their settings: {found}")
    return indexes[0].settings


@dataclass(frozen=True)
class Part:
    """A part of a version: its folder, the id at which it begins, how many ids and rows it has, and its most frequent word."""

    name: str
    first: int
    ids: int
    rows: int
    most: int


@dataclass(frozen=True)
class Version:
    """What an index is at a time. ``batches``: the last batch of each stream."""

    number: int
    settings: Settings
    buckets: int
    parts: tuple[Part, ...] = ()
    batches: tuple[tuple[str, int], ...] = ()

    @property
    def next_id(self) -> int:
        return max((p.first + p.ids for p in self.parts), default=0)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Version:
        x = json.loads(text)
        return cls(x["number"], Settings(**x["settings"]), x["buckets"], tuple(Part(**p) for p in x["parts"]), tuple((s, n) for s, n in x["batches"]))


def _version_path(path: str, number: int) -> str:
    return f"{path}/versions/{number:012}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are there, ascending."""
    return [int(n.removesuffix(".json")) for n in children(spark, f"{path}/versions") if n.endswith(".json") and not n.startswith(".")]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of the index at ``path``, the last one if no number is given."""
    if number is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"there is no index at {path}")
        number = found[-1]
    return Version.of(text_of(spark, _version_path(path, number)))


def _commit(spark: SparkSession, path: str, change: Callable[[Version], Version | None]) -> Version:
    """Make a change to the last version. If another writer is faster, it is made again upon theirs; None: there is none to make."""
    while True:
        now = version(spark, path)
        new = change(now)
        if new is None:
            return now
        new = replace(new, number=now.number + 1)
        if put_new(spark, _version_path(path, new.number), new.text()):
            return new


def _table(spark: SparkSession, path: str, kind: str, parts: tuple[Part, ...], buckets: int) -> DataFrame:
    """The rows of some parts, with ``first``, the id at which their part begins. The table is named by what it holds."""
    columns = SAMPLES if kind == "samples" else POSTINGS
    if not parts:
        return spark.createDataFrame([], f"{columns}, first long, part string")
    base = qualified(spark, path).replace("'", "\\'")
    key = json.dumps([base, kind, buckets, *((p.name, p.first) for p in parts)])
    name = f"setloom_{kind}_{hashlib.sha1(key.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        clustered = f"CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS" if kind == "postings" else ""
        where = " ".join(f"PARTITION (first={p.first}, part='{p.name}') LOCATION '{base}/parts/{p.name}/{kind}'" for p in parts)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns.replace(' long', ' BIGINT')}, first BIGINT, part STRING) USING parquet PARTITIONED BY (first, part) {clustered} LOCATION '{base}/none'")
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {where}")
    return spark.table(name)


def _global(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select((F.col("sample_id") + F.col("first")).alias("sample_id"), *columns)


def _joined(samples: DataFrame, parts: tuple[Part, ...]) -> DataFrame:
    """``samples`` (sample_id, name, n_kmers) of some parts with one row a sample: parts whose ids overlap may share samples,
    but never a word of one."""
    ends = sorted((p.first, p.first + p.ids) for p in parts)
    if all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)):
        return samples
    return samples.groupBy("sample_id").agg(F.min("name").alias("name"), F.sum("n_kmers").alias("n_kmers"))


def create(spark: SparkSession, path: str, settings: Settings, buckets: int | None = None) -> Index:
    """An empty index at ``path``, where there must be none. Its postings have as many buckets as the session's shuffles have
    partitions, if no number is given: a bucket of a part should fit a task."""
    settings.check()
    first = Version(0, settings, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if versions(spark, path) or not put_new(spark, _version_path(path, 0), first.text()):
        raise FileExistsError(f"there is an index at {path}")
    return load(spark, path)


def _written(spark: SparkSession, path: str, samples: DataFrame, post: DataFrame, buckets: int) -> Part:
    """A new part: postings, then samples (sample_id, name) with sizes of what was written, so that words are made once.

    It belongs to no version yet; its ids are taken to begin at 0.
    """
    name = uuid.uuid4().hex
    at = f"{qualified(spark, path)}/parts/{name}"
    _write_bucketed(post.select("sample_id", "kmer").repartition(buckets, "kmer"), f"{at}/postings", buckets)
    written = _table(spark, path, "postings", (Part(name, 0, 0, 0, 0),), buckets)
    cardinalities(written.select("sample_id", "kmer"), samples.select("sample_id", "name")).write.parquet(f"{at}/samples")
    return _measured(spark, path, name, written)


def _write_bucketed(post: DataFrame, at: str, buckets: int) -> None:
    """Write postings to a folder, a file a bucket and task. A table is made for it and forgotten; its files stay."""
    table = f"setloom_new_{uuid.uuid4().hex}"
    post.write.bucketBy(buckets, "kmer").sortBy("kmer").option("path", at).saveAsTable(table)
    post.sparkSession.sql(f"DROP TABLE {table}")


def _measured(spark: SparkSession, path: str, name: str, written: DataFrame) -> Part:
    words = written.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()  # no exchange of words
    last = spark.read.schema(SAMPLES).parquet(f"{path}/parts/{name}/samples").agg(F.max("sample_id")).first()[0]
    return Part(name, 0, 0 if last is None else last + 1, words[0] or 0, words[1] or 0)


def save(index: Index, path: str, buckets: int | None = None) -> Index:
    """Write an index."""
    spark = index.postings.sparkSession
    create(spark, path, index.settings, buckets)
    return _append(spark, path, index.samples, index.postings)


def load(spark: SparkSession, path: str, number: int | None = None) -> Index:
    """The index at ``path`` as it is now, or as a version of it was. What others add later isn't seen."""
    v = version(spark, path, number)
    samples, post = (_table(spark, path, kind, v.parts, v.buckets) for kind in ("samples", "postings"))
    return Index(_joined(_global(samples, "name", "n_kmers"), v.parts), _global(post, "kmer"), v.settings, sum(p.most for p in v.parts))


def _append(spark: SparkSession, path: str, samples: DataFrame, post: DataFrame, batch: tuple[str, int] | None = None) -> Index:
    part = _written(spark, path, samples, post, version(spark, path).buckets)

    def change(now: Version) -> Version | None:
        last = dict(now.batches)
        if batch is not None:
            if last.get(batch[0], -1) >= batch[1]:
                return None  # another run of the batch was faster
            last[batch[0]] = batch[1]
        more = (replace(part, first=now.next_id),) if part.ids else ()
        return replace(now, parts=now.parts + more, batches=tuple(sorted(last.items())))

    return load(spark, path, _commit(spark, path, change).number)


def extend(spark: SparkSession, path: str, samples: DataFrame, sequences: DataFrame, batch: tuple[str, int] | None = None) -> Index:
    """Add samples to a stored index; what is there isn't rewritten, and their ids follow the ids there.

    All of them appear at once. A failed call leaves the index as it was, and may be made again. A ``batch`` (stream, number)
    that is there already isn't added again; a stream's numbers ascend.
    """
    now = version(spark, path)
    if batch is not None and dict(now.batches).get(batch[0], -1) >= batch[1]:
        return load(spark, path)
    s = now.settings
    return _append(spark, path, samples, postings(sequences, s.k, s.letters, s.fraction, s.fraction_start), batch)


def merge(spark: SparkSession, path: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> Index:
    """Add sequences (name, seq) to a stored index by their samples' names.

    A name that is there gets the words that it lacks; of samples that share a name, the one with the smallest id. Other names
    are new samples, whose ids follow the ids there in the order of the names' hashes. A null name is a name. The rest is as with ``extend``: all
    at once or not at all, and a ``batch`` once. Of the stored postings only those of the named samples are read beyond their
    ids. If another writer adds samples or words meanwhile, the part is made again, as its ids are not relative.
    """
    rows, part, upon = rows.select("name", "seq"), None, None
    while True:
        now = version(spark, path)
        last = dict(now.batches)
        if batch is not None:
            if last.get(batch[0], -1) >= batch[1]:
                return load(spark, path)
            last[batch[0]] = batch[1]
        state = (now.next_id, now.batches, sum(p.rows for p in now.parts))
        if upon != state:  # compaction leaves the state as it is
            part, upon = _merge_part(spark, path, rows, now), state
        new = replace(now, number=now.number + 1, parts=(*now.parts, *((part,) if part.ids else ())), batches=tuple(sorted(last.items())))
        if put_new(spark, _version_path(path, new.number), new.text()):
            return load(spark, path, new.number)


def _merge_part(spark: SparkSession, path: str, rows: DataFrame, now: Version) -> Part:
    """A part from id 0 on with the words of ``rows`` (name, seq) that a version's samples of these names lack."""
    s, index = now.settings, load(spark, path, now.number)
    names = rows.select("name").distinct()
    there = index.samples.groupBy(F.col("name").alias("_name")).agg(F.min("sample_id").alias("sample_id"))
    same = F.col("name").eqNullSafe(F.col("_name"))
    known = names.join(there, same).select("name", "sample_id")
    fresh = numbered_names(names.join(there, same, "left_anti"))
    ids = known.unionAll(fresh.select("name", F.col("sample_id") + now.next_id))
    of = ids.select(F.col("name").alias("_name"), "sample_id")
    post = postings(rows.join(of, same).select("sample_id", "seq"), s.k, s.letters, s.fraction, s.fraction_start)
    stored = index.postings.join(known.select("sample_id"), "sample_id", "left_semi")
    return _written(spark, path, ids, post.join(stored, ["sample_id", "kmer"], "left_anti"), now.buckets)


def build_stored(spark: SparkSession, path: str, samples: DataFrame, sequences: DataFrame, settings: Settings, buckets: int | None = None) -> Index:
    """``build``, written to ``path``: words are made once, however many questions are asked."""
    create(spark, path, settings, buckets)
    return extend(spark, path, samples, sequences)


def _level(part: Part, fan: int) -> int:
    level, size = 0, LEAST_ROWS
    while part.rows > size:
        level, size = level + 1, size * fan
    return level


def _due(parts: tuple[Part, ...], fan: int) -> tuple[Part, ...]:
    """The first run of ``fan`` adjacent parts or more that have one level at most, the lowest such level; () if there is none."""
    levels = [_level(p, fan) for p in parts]
    for level in sorted(set(levels)):
        run: list[Part] = []
        for p, own in [*zip(parts, levels, strict=True), (None, None)]:
            if p is not None and own <= level:
                run.append(p)
            elif len(run) >= fan:
                return tuple(run)
            else:
                run = []
    return ()


def compact(spark: SparkSession, path: str, fan: int = FAN) -> Version:
    """Merge runs of adjacent parts of about one size until there are none: the number of parts grows with the logarithm of
    the rows, and a row is written again as often. Sample ids stay. Versions before read the parts before."""
    if fan < 2:
        raise ValueError("at least two parts are merged")
    while True:
        now = version(spark, path)
        run = _due(now.parts, fan)
        if not run:
            return now
        part, first = _merged(spark, path, run, now.buckets), min(p.first for p in run)

        def change(now: Version, run=run, part=part, first=first) -> Version | None:
            at = now.parts.index(run[0]) if run[0] in now.parts else -1
            if at < 0 or now.parts[at : at + len(run)] != run:
                return None  # another compaction was faster
            return replace(now, parts=(*now.parts[:at], replace(part, first=first), *now.parts[at + len(run) :]))

        _commit(spark, path, change)


def _merged(spark: SparkSession, path: str, run: tuple[Part, ...], buckets: int) -> Part:
    """One part of a run of parts. A bucket of it is made of the same bucket of each, without an exchange."""
    name, first = uuid.uuid4().hex, F.lit(min(p.first for p in run))
    at = f"{qualified(spark, path)}/parts/{name}"
    moved = (F.col("sample_id") + F.col("first") - first).alias("sample_id")
    _write_bucketed(_table(spark, path, "postings", run, buckets).select(moved, "kmer"), f"{at}/postings", buckets)
    _joined(_table(spark, path, "samples", run, buckets).select(moved, "name", "n_kmers"), run).write.parquet(f"{at}/samples")
    return _measured(spark, path, name, _table(spark, path, "postings", (Part(name, 0, 0, 0, 0),), buckets))


def vacuum(spark: SparkSession, path: str, keep: int = 1, older_than: float = 24 * 3600.0) -> list[str]:
    """Delete all versions but the last ``keep``, and the parts that none of these has and that nobody has written to for so many
    seconds, as an extension may be writing its part. Returns the names of deleted parts."""
    numbers = versions(spark, path)
    kept = {p.name for n in numbers[-keep:] for p in version(spark, path, n).parts}
    for n in numbers[:-keep]:
        delete(spark, _version_path(path, n))
    gone = [p for p in children(spark, f"{path}/parts") if p not in kept and aged(spark, f"{path}/parts/{p}") >= older_than]
    for p in gone:
        delete(spark, f"{path}/parts/{p}")
    return gone
