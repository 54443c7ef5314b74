"""One query for each operator, over tables whose rows are taken as samples.

Documents, benchmark items and conversations are texts of protein letters; a user's events in order are a nucleotide
sequence; a supplier's parts are a ready-made set. ``ORACLES`` has independent SQL for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import alphabet
from .functions.metrics import MEASURES, rounded
from .operators import extract, overlap, select
from .plans import files, modes, render, store
from .plans.store import Index, Settings
from .sources.counts_table import read_counts_table
from .sources.dispatch import read_samples
from .sources.paths import children, work_folder
from .streaming.extend import extend_from_stream

K = 8
AA = Settings(K, "aa")
#: A user's events as letters; errors are no letter of the alphabet.
EVENT_LETTERS = {"click": "A", "view": "C", "purchase": "G", "signup": "T", "error": "N"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, sample: str) -> tuple[DataFrame, DataFrame]:
    """(samples, sequences) of a table of texts; several rows of a sample are its contigs."""
    t = table(spark, sf_dir, name)
    ids = t.select(F.col(sample).alias("sample_id")).distinct().select("sample_id", F.col("sample_id").cast("string").alias("name"))
    return ids, t.select(F.col(sample).alias("sample_id"), F.col("text").alias("seq"))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that executors share."""
    return f"{work_folder(spark)}/setloom/queries/{name}-{uuid.uuid4().hex}"


def built(spark: SparkSession, sf_dir: str, name: str, sample: str, settings: Settings = AA) -> Index:
    """The index of a table, worked out when it is asked: for queries that read it once."""
    return store.build(*texts(spark, sf_dir, name, sample), settings)


def stored(spark: SparkSession, sf_dir: str, name: str, sample: str, settings: Settings = AA) -> Index:
    """The index of a table, written first: words are extracted once, however often the query reads them."""
    return store.build_stored(spark, work_path(spark, name), *texts(spark, sf_dir, name, sample), settings)


def documents(spark: SparkSession, sf_dir: str, settings: Settings = AA) -> Index:
    return stored(spark, sf_dir, "documents", "doc_id", settings)


def conversations(spark: SparkSession, sf_dir: str, settings: Settings = AA) -> Index:
    return stored(spark, sf_dir, "conversations", "conv_id", settings)


def benchmark(spark: SparkSession, sf_dir: str, settings: Settings = AA) -> Index:
    return stored(spark, sf_dir, "benchmark", "item_id", settings)


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    letter = F.element_at(F.create_map(*[F.lit(x) for pair in EVENT_LETTERS.items() for x in pair]), F.col("event_type"))
    lists = e.groupBy(F.col("user_id").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", letter.alias("letter")))).alias("_l"))
    return lists.select("sample_id", F.array_join(F.transform("_l", lambda x: x["letter"]), "").alias("seq"))


def suppliers(spark: SparkSession, sf_dir: str) -> Index:
    items = extract.item_sets(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    names = items.select("sample_id").distinct().withColumn("name", F.col("sample_id").cast("string"))
    return Index(extract.cardinalities(items, names), items, Settings(18, "nt"))


def spelled(post: DataFrame, settings: Settings) -> DataFrame:
    return post.select("sample_id", settings.letters.unpacked(F.col("kmer"), settings.k).alias("kmer"))


# ---- SQL pieces -----------------------------------------------------------------------------------------------------


def sql_words(name: str, source: str, sample: str, text: str, settings: Settings) -> str:
    """CTEs that end in ``name`` (sample_id, kmer): distinct words as strings."""
    a = settings.letters
    word = f"least(w, translate(reverse(w), '{a.symbols}', '{a.symbols[::-1]}'))" if a.canonical else "w"
    return f"""
{name}_r AS (SELECT {sample} AS sample_id, unnest(regexp_extract_all(translate({text}, '{a.letters}', '{a.leads}'), '[{a.symbols}]{{{settings.k},}}')) AS r FROM {source}),
{name}_w AS (SELECT sample_id, substr(r, i, {settings.k}) AS w FROM (SELECT sample_id, r, unnest(generate_series(1, length(r) - {settings.k} + 1)) AS i FROM {name}_r)),
{name} AS (SELECT DISTINCT sample_id, {word} AS kmer FROM {name}_w)"""


def sql_sizes(name: str, source: str, sample: str) -> str:
    """``name``_n (sample_id, n_kmers), zeros included."""
    return f"""
{name}_n AS (SELECT s.sample_id, count(p.kmer)::BIGINT AS n_kmers
  FROM (SELECT DISTINCT {sample} AS sample_id FROM {source}) s LEFT JOIN {name} p ON s.sample_id = p.sample_id GROUP BY 1)"""


def sql_set(name: str, settings: Settings = AA) -> str:
    source, sample = {"docs": ("documents", "doc_id"), "convs": ("conversations", "conv_id"), "items": ("benchmark", "item_id")}[name]
    return sql_words(name, source, sample, "text", settings) + "," + sql_sizes(name, source, sample)


def sql_pairs(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT x.sample_id AS row_id, y.sample_id AS col_id, count(*)::BIGINT AS common
  FROM {source} x JOIN {source} y ON x.kmer = y.kmer AND y.sample_id < x.sample_id GROUP BY 1, 2)"""


def sql_sized(name: str, pairs: str, rows: str, columns: str) -> str:
    return f"""
{name} AS (SELECT p.*, a.n_kmers AS n_row, b.n_kmers AS n_col FROM {pairs} p
  JOIN {rows}_n a ON a.sample_id = p.row_id JOIN {columns}_n b ON b.sample_id = p.col_id)"""


_J, _M = "(common::DOUBLE / (n_row + n_col - common))", "(common::DOUBLE / least(n_row, n_col))"


def _sql_mash(j: str) -> str:
    return f"(CASE WHEN {j} = 0 THEN 1.0 ELSE -1.0 / {K} * ln(2 * {j} / (1 + {j})) + 0.0 END)"


SQL_MEASURES = {
    "jaccard": _J,
    "min": _M,
    "max": "(common::DOUBLE / greatest(n_row, n_col))",
    "cosine": "(common::DOUBLE / sqrt(n_row::DOUBLE * n_col::DOUBLE))",
    "mash": _sql_mash(_J),
    "ani": f"(1 - {_sql_mash(_J)})",
    "ani-shorter": f"(1 - {_sql_mash(_M)})",
    "mash-query": _sql_mash("(common::DOUBLE / n_row)"),
}

EVENTS_SQL = """
seqs AS (SELECT user_id, string_agg(CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END, '' ORDER BY ts, event_id) AS text
  FROM events GROUP BY user_id)"""

DOC_PAIRS = f"WITH {sql_set('docs')}, {sql_pairs('pairs', 'docs')}, {sql_sized('sized', 'pairs', 'docs', 'docs')}"
_PAIR = "row_id, col_id, common"

# ---- extraction -----------------------------------------------------------------------------------------------------


def _extraction(name: str, settings: Settings, source: str) -> None:
    if source == "documents":
        sql = f"WITH {sql_words('p', 'documents', 'doc_id', 'text', settings)} SELECT sample_id, kmer FROM p"
    else:
        sql = f"WITH {EVENTS_SQL}, {sql_words('p', 'seqs', 'user_id', 'text', settings)} SELECT sample_id, kmer FROM p"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sequences = texts(spark, sf_dir, "documents", "doc_id")[1] if source == "documents" else event_sequences(spark, sf_dir)
        return spelled(extract.postings(sequences, settings.k, settings.letters), settings)

    run.__name__ = name
    query(sql)(run)


_extraction("kmer_extract_aa", AA, "documents")
_extraction("kmer_extract_dayhoff", Settings(K, "aa6_dayhoff"), "documents")
_extraction("kmer_extract_diamond", Settings(K, "aa11_diamond"), "documents")
_extraction("kmer_extract_mmseqs", Settings(K, "aa12_mmseqs"), "documents")
_extraction("kmer_extract_nt_preserve", Settings(5, "nt", True), "events")
_extraction("kmer_extract_nt_canonical", Settings(5, "nt"), "events")


@query(f"WITH {sql_set('docs')} SELECT sample_id, n_kmers FROM docs_n")
def sample_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "documents", "doc_id").samples.select("sample_id", "n_kmers")


@query(f"WITH {sql_set('convs')} SELECT sample_id, n_kmers FROM convs_n")
def multi_contig_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "conversations", "conv_id").samples.select("sample_id", "n_kmers")


@query(
    f"""WITH {sql_set("docs")}, sets AS (SELECT kmer, list_sort(list(sample_id)) AS s FROM docs GROUP BY kmer)
SELECT (SELECT count(*)::BIGINT FROM docs_n) AS n_samples, count(*)::BIGINT AS n_kmers, count(DISTINCT s)::BIGINT AS n_patterns, {K}::INTEGER AS k, 1.0::DOUBLE AS fraction FROM sets"""
)
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).stats()


@query(
    f"""WITH {sql_set("docs")}, sets AS (SELECT kmer, array_to_string(list_sort(list(sample_id)), ',') AS samples FROM docs GROUP BY kmer)
SELECT samples, count(*)::BIGINT AS num_kmers FROM sets GROUP BY samples"""
)
def pattern_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.patterns(documents(spark, sf_dir).postings).select(F.array_join("samples", ",").alias("samples"), "num_kmers")


_CODES = f"'{AA.letters.symbols}', 'ABCDEFGHIJKLMNOPQRST'"


@query(
    f"""WITH {sql_set("docs")}, sets AS (SELECT kmer, list_sort(list(sample_id)) AS s FROM docs GROUP BY kmer),
classes AS (SELECT s, min(translate(kmer, {_CODES})) AS lead, count(*)::BIGINT AS num_kmers FROM sets GROUP BY s)
SELECT translate(lead, 'ABCDEFGHIJKLMNOPQRST', '{AA.letters.symbols}') AS pattern, unnest(s) AS sample_id, len(s)::BIGINT AS n_samples, num_kmers FROM classes"""
)
def pattern_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of every pattern, a row each; a pattern is named by its first word in the order of codes."""
    out = overlap.pattern_members(documents(spark, sf_dir).postings)
    return out.select(AA.letters.unpacked(F.col("pattern"), K).alias("pattern"), "sample_id", "n_samples", "num_kmers")


@query(f"WITH {sql_set('docs')} SELECT kmer, count(*)::BIGINT AS n_samples FROM docs WHERE kmer IN (SELECT kmer FROM docs WHERE sample_id % 20 = 0) GROUP BY kmer")
def kmer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every twentieth document, looked up in all."""
    index = documents(spark, sf_dir)
    found = overlap.lookup(index.postings, index.postings.where("sample_id % 20 = 0"))
    return found.select(AA.letters.unpacked(F.col("kmer"), K).alias("kmer"), "n_samples")


@query(
    f"""WITH {sql_set("docs")}, {sql_set("items")}, counts AS (SELECT kmer, count(*)::BIGINT AS n FROM docs GROUP BY kmer)
SELECT kmer, coalesce(n, 0)::BIGINT AS n_samples FROM (SELECT DISTINCT kmer FROM items) LEFT JOIN counts USING (kmer)"""
)
def kmer_lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a whole table looked up in another, so that what is looked up grows with the input."""
    found = overlap.lookup(documents(spark, sf_dir).postings, benchmark(spark, sf_dir).postings)
    return found.select(AA.letters.unpacked(F.col("kmer"), K).alias("kmer"), "n_samples")


@query(
    """SELECT l_suppkey AS sample_id, l_partkey AS kmer FROM lineitem GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 3"""
)
def counted_kmer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return extract.counted_words(counted, "l_suppkey", "l_partkey", "n", 2, 3)


# ---- overlap --------------------------------------------------------------------------------------------------------


@query(f"{DOC_PAIRS} SELECT {_PAIR} FROM pairs")
def all2all_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)
    return overlap.all2all(index.postings, most=index.most, runs=True)


@query(f"{DOC_PAIRS} SELECT {_PAIR} FROM pairs")
def all2all_pattern_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)
    return overlap.all2all_by_patterns(index.postings, most=index.most, runs=True)


@query(
    f"""WITH {sql_set("convs")}, {sql_pairs("pairs", "convs")}
SELECT a.sample_id AS row_id, b.sample_id AS col_id, coalesce(p.common, 0)::BIGINT AS common
FROM convs_n a JOIN convs_n b ON b.sample_id < a.sample_id LEFT JOIN pairs p ON p.row_id = a.sample_id AND p.col_id = b.sample_id"""
)
def all2all_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = conversations(spark, sf_dir)
    return overlap.all2all_dense(index.postings, index.samples)


_BOTH = f"""WITH {sql_set("convs")}, {sql_set("items")}, shift AS (SELECT max(sample_id) + 1 AS d FROM convs_n),
every AS (SELECT sample_id, kmer FROM convs UNION ALL SELECT sample_id + d, kmer FROM items, shift),
every_n AS (SELECT sample_id, n_kmers FROM convs_n UNION ALL SELECT sample_id + d, n_kmers FROM items_n, shift)"""


@query(f"{_BOTH}, {sql_pairs('pairs', 'every')} SELECT {_PAIR} FROM pairs")
def all2all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs = modes.all2all_parts([conversations(spark, sf_dir), benchmark(spark, sf_dir)])
    return pairs.select("row_id", "col_id", "common")


@query(f"{_BOTH}, {sql_pairs('pairs', 'every')} SELECT {_PAIR} FROM pairs")
def all2all_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored indexes that a list file names, as one."""
    paths = [work_path(spark, name) for name in ("first", "second", "list")]
    for path, source in zip(paths, (("conversations", "conv_id"), ("benchmark", "item_id")), strict=False):
        store.build_stored(spark, path, *texts(spark, sf_dir, *source), AA)
    spark.createDataFrame([(" ".join(paths[:2]),)], "value string").coalesce(1).write.text(paths[2])
    return modes.all2all_listed(spark, paths[2])[1].select("row_id", "col_id", "common")


@query(f"{_BOTH}, {sql_pairs('pairs', 'every')} SELECT {_PAIR} FROM pairs")
def compacted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a stored index that grew in batches, after its parts were merged."""
    path = work_path(spark, "batches")
    store.build_stored(spark, path, *texts(spark, sf_dir, "conversations", "conv_id"), AA)
    store.extend(spark, path, *texts(spark, sf_dir, "benchmark", "item_id"))
    store.compact(spark, path, fan=2)
    index = store.load(spark, path)
    return overlap.all2all(index.postings, most=index.most)


@query(f"WITH {sql_set('convs')} SELECT sample_id::VARCHAR AS name, kmer, n_kmers FROM convs JOIN convs_n USING (sample_id)")
def stream_merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that reach a stored index by a stream, their turns in two batches: each is one sample all the same."""
    path, source = work_path(spark, "merged"), work_path(spark, "turns")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name"), F.col("text").alias("seq"), (F.col("turn") % 2).alias("half"))
    for half in (0, 1):
        turns.where(F.col("half").eqNullSafe(half) if half else F.coalesce(F.col("half"), F.lit(0)) == 0).drop("half").coalesce(1).write.mode("append").parquet(source)
    store.create(spark, path, AA)
    stream = spark.readStream.schema("name string, seq string").option("maxFilesPerTrigger", 1).parquet(source)
    extend_from_stream(stream, path, work_path(spark, "stream")).awaitTermination()
    index = store.load(spark, path)
    return spelled(index.postings, AA).join(index.samples, "sample_id").select("name", "kmer", "n_kmers")


@query(f"{_BOTH} SELECT sample_id, n_kmers FROM every_n")
def extend_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = store.extended(conversations(spark, sf_dir), *texts(spark, sf_dir, "benchmark", "item_id"))
    return grown.samples.select("sample_id", "n_kmers")


_CROSS = f"""WITH {sql_set("items")}, {sql_set("docs")},
pairs AS (SELECT x.sample_id AS row_id, y.sample_id AS col_id, count(*)::BIGINT AS common FROM items x JOIN docs y ON x.kmer = y.kmer GROUP BY 1, 2),
{sql_sized("sized", "pairs", "items", "docs")}"""


@query(f"{_CROSS} SELECT {_PAIR} FROM pairs")
def cross_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, index = benchmark(spark, sf_dir), documents(spark, sf_dir)
    return overlap.cross(new.postings, index.postings, most=new.most * index.most)


@query(f"{_CROSS} SELECT {_PAIR}, n_row, n_col FROM sized WHERE {_M} >= 0.05 AND common >= 2")
def new2all_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = modes.new2all(benchmark(spark, sf_dir), documents(spark, sf_dir), {"min": 0.05, "num-kmers": 2})
    return out.select("row_id", "col_id", "common", "n_row", "n_col")


@query(
    f"""WITH {sql_set("items")}, {sql_set("convs")},
pairs AS (SELECT x.sample_id AS row_id, y.sample_id AS col_id, count(*)::BIGINT AS common FROM items x JOIN convs y ON x.kmer = y.kmer GROUP BY 1, 2)
SELECT a.sample_id AS row_id, b.sample_id AS col_id, coalesce(p.common, 0)::BIGINT AS common
FROM items_n a CROSS JOIN convs_n b LEFT JOIN pairs p ON p.row_id = a.sample_id AND p.col_id = b.sample_id"""
)
def new2all_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, index = benchmark(spark, sf_dir), conversations(spark, sf_dir)
    return overlap.new2all_dense(new.postings, new.samples, index.postings, index.samples)


@query(
    f"""WITH {sql_set("items")}, {sql_set("docs")}, one AS (SELECT kmer FROM items WHERE sample_id = 0)
SELECT n.sample_id, count(o.kmer)::BIGINT AS common FROM docs_n n LEFT JOIN docs d ON d.sample_id = n.sample_id LEFT JOIN one o ON o.kmer = d.kmer GROUP BY 1"""
)
def one2all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = built(spark, sf_dir, "documents", "doc_id")
    return overlap.one2all(first_item(spark, sf_dir).postings, index.postings, texts(spark, sf_dir, "documents", "doc_id")[0])


def first_item(spark: SparkSession, sf_dir: str) -> Index:
    """The index of one sample, the first benchmark item."""
    samples, sequences = texts(spark, sf_dir, "benchmark", "item_id")
    return store.build(samples.where("sample_id = 0"), sequences.where("sample_id = 0"), AA)


@query(f"{_BOTH}, {sql_pairs('pairs', 'every')} SELECT {_PAIR} FROM pairs")
def stored_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an index on storage, after samples were added to it."""
    path = work_path(spark, "grown")
    store.build_stored(spark, path, *texts(spark, sf_dir, "conversations", "conv_id"), AA)
    grown = store.extend(spark, path, *texts(spark, sf_dir, "benchmark", "item_id"))
    return overlap.all2all(grown.postings, most=grown.most)


@query(f"{_BOTH} SELECT sample_id, n_kmers FROM every_n")
def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "grown")
    store.build_stored(spark, path, *texts(spark, sf_dir, "conversations", "conv_id"), AA)
    store.extend(spark, path, *texts(spark, sf_dir, "benchmark", "item_id"))
    return store.load(spark, path).samples.select("sample_id", "n_kmers")


@query(
    f"""WITH p AS (SELECT DISTINCT l_suppkey AS sample_id, l_partkey AS kmer FROM lineitem),
p_n AS (SELECT sample_id, count(*)::BIGINT AS n_kmers FROM p GROUP BY 1), {sql_pairs("pairs", "p")}, {sql_sized("sized", "pairs", "p", "p")}
SELECT row_id, col_id, common, n_row, n_col, round({_J}, 6) AS value FROM sized"""
)
def itemset_all2all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = suppliers(spark, sf_dir)
    sized = overlap.all2all_sized(index.postings, index.samples)
    return select.scored(sized, "jaccard", index.settings.k).withColumn("value", rounded(F.col("value")))


# ---- measures and selection -----------------------------------------------------------------------------------------


def _measured(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = modes.distances(modes.all2all(documents(spark, sf_dir), runs=True), name, K)
        return out.select("row_id", "col_id", rounded(F.col("value")).alias("value"))

    run.__name__ = "metric_" + name.replace("-", "_")
    query(f"{DOC_PAIRS} SELECT row_id, col_id, round({SQL_MEASURES[name]}, 6) AS value FROM sized")(run)


for _name in MEASURES:
    if _name != "num-kmers":
        _measured(_name)


@query(f"{DOC_PAIRS} SELECT {_PAIR}, round({_J}, 6) AS value FROM sized WHERE {_J} >= 0.1 AND {_J} <= 0.9")
def filter_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = modes.all2all(documents(spark, sf_dir), {"jaccard": 0.1}, {"jaccard": 0.9})
    return select.scored(pairs, "jaccard", K).select("row_id", "col_id", "common", rounded(F.col("value")).alias("value"))


@query(f"{DOC_PAIRS} SELECT {_PAIR}, n_row, n_col FROM sized WHERE {_J} >= 0.5")
def filter_jaccard_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A high bound: of the words of two samples or more, the join reads a third."""
    return modes.all2all(documents(spark, sf_dir), {"jaccard": 0.5})


@query(f"{DOC_PAIRS} SELECT {_PAIR} FROM sized WHERE {SQL_MEASURES['cosine']} >= 0.6 AND {SQL_MEASURES['mash']} <= 0.05")
def filter_mash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from above and below, each of which asks for a share of the larger set."""
    return modes.all2all(documents(spark, sf_dir), {"cosine": 0.6}, {"mash": 0.05}).select("row_id", "col_id", "common")


@query(f"{DOC_PAIRS} SELECT {_PAIR} FROM sized WHERE common >= 3 AND common <= 200 AND {_M} >= 0.05 AND {SQL_MEASURES['mash']} <= 0.3")
def filter_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = modes.all2all(documents(spark, sf_dir), {"num-kmers": 3, "min": 0.05}, {"num-kmers": 200, "mash": 0.3})
    return pairs.select("row_id", "col_id", "common")


_TURNED = "both_ways AS (SELECT row_id, col_id, common, {m} AS v FROM sized UNION ALL SELECT col_id, row_id, common, {m} FROM sized)"


@query(
    f"""{DOC_PAIRS}, {_TURNED.format(m=_J)},
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v DESC, col_id) AS n FROM both_ways) SELECT row_id, col_id, common, round(v, 6) AS value FROM r WHERE n <= 3"""
)
def sample_rows_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = modes.all2all(documents(spark, sf_dir), sample_rows=3, by="jaccard")
    return select.scored(best, "jaccard", K).select("row_id", "col_id", "common", rounded(F.col("value")).alias("value"))


@query(
    f"""{DOC_PAIRS}, {_TURNED.format(m=_J)}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY md5(row_id || ',' || col_id || ',0'), col_id) AS n FROM both_ways)
SELECT row_id, col_id, common FROM r WHERE n <= 3"""
)
def sample_rows_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.all2all(documents(spark, sf_dir), sample_rows=3).select("row_id", "col_id", "common")


# ---- sketches -------------------------------------------------------------------------------------------------------


def sql_hashed(name: str, source: str, settings: Settings) -> str:
    """``name`` (sample_id, kmer, h): the words of ``source`` with their hash as an unsigned number."""
    bits, k, two64 = settings.letters.bits, settings.k, "18446744073709551616::UHUGEINT"

    def mul(x: str, c: int) -> str:
        return f"(({x}::UHUGEINT * {c}::UHUGEINT) % {two64})"

    def add(x: str, y: str) -> str:
        return f"(({x}::UHUGEINT + {y}::UHUGEINT) % {two64})"

    shift = 40 - k * bits
    pad = f"((p << {shift}) | (p & {(1 << shift) - 1}::UBIGINT))" if shift > 0 else "p"
    length = 42 ^ -(-k // 4)
    steps = [
        f"{name}_0 AS (SELECT sample_id, kmer, list_sum(list_transform(generate_series(1, {k}), lambda i: ((instr('{settings.letters.symbols}', substr(kmer, i, 1)) - 1)::HUGEINT << ({bits} * ({k} - i))::INTEGER)))::UBIGINT AS p FROM {source})",
        f"{name}_1 AS (SELECT sample_id, kmer, {mul(pad, 0x87C37B91114253D5)} AS u FROM {name}_0)",
        f"{name}_2 AS (SELECT sample_id, kmer, {mul(f'(((u * 2147483648::UHUGEINT) % {two64}) + u // 8589934592::UHUGEINT)', 0x4CF5AD432745937F)}::UBIGINT AS u FROM {name}_1)",
        f"{name}_3 AS (SELECT sample_id, kmer, {add(f'xor({length}::UBIGINT, u)', str(length))}::UBIGINT AS a FROM {name}_2)",
        f"{name}_4 AS (SELECT sample_id, kmer, a, {add(str(length), 'a')}::UBIGINT AS b FROM {name}_3)",
    ]
    at = 4
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        steps.append(f"{name}_{at + 1} AS (SELECT sample_id, kmer, {mul('xor(a, a >> 33)', c)}::UBIGINT AS a, {mul('xor(b, b >> 33)', c)}::UBIGINT AS b FROM {name}_{at})")
        at += 1
    steps.append(f"{name}_{at + 1} AS (SELECT sample_id, kmer, xor(a, a >> 33) AS a, xor(b, b >> 33) AS b FROM {name}_{at})")
    steps.append(f"{name}_{at + 2} AS (SELECT sample_id, kmer, {add('a', 'b')}::UBIGINT AS a, b FROM {name}_{at + 1})")
    steps.append(f"{name} AS (SELECT sample_id, kmer, xor(a, {add('a', 'b')}::UBIGINT) AS h FROM {name}_{at + 2})")
    return ", ".join(steps)


def _bounds_sql(fraction: float, start: float = 0.0) -> str:
    low, high = int(float(2**64) * start), int(float(2**64) * (start + fraction))
    return f"h >= {low}::UBIGINT" + (f" AND h < {high}::UBIGINT" if high < 2**64 else "")


@query(f"WITH {sql_set('docs')}, {sql_hashed('hashed', 'docs', AA)} SELECT sample_id, kmer FROM hashed WHERE {_bounds_sql(0.25)}")
def minhash_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(built(spark, sf_dir, "documents", "doc_id", Settings(K, "aa", fraction=0.25)).postings, AA)


@query(f"WITH {sql_set('docs')}, {sql_hashed('hashed', 'docs', AA)} SELECT sample_id, kmer FROM hashed WHERE {_bounds_sql(0.5, 0.25)}")
def minhash_fraction_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(built(spark, sf_dir, "documents", "doc_id", Settings(K, "aa", fraction=0.5, fraction_start=0.25)).postings, AA)


_NT6 = Settings(6, "nt")


@query(
    f"WITH {EVENTS_SQL}, {sql_words('p', 'seqs', 'user_id', 'text', _NT6)}, {sql_hashed('hashed', 'p', _NT6)} SELECT sample_id, kmer FROM hashed WHERE {_bounds_sql(0.5)}"
)
def minhash_nt_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(extract.postings(event_sequences(spark, sf_dir), 6, _NT6.letters, 0.5), _NT6)


@query(
    f"""WITH {sql_set("items")}, {sql_set("docs")}, {sql_hashed("hi", "items", AA)}, {sql_hashed("hd", "docs", AA)}
SELECT x.sample_id AS row_id, y.sample_id AS col_id, count(*)::BIGINT AS common FROM (SELECT * FROM hi WHERE {_bounds_sql(0.5)}) x JOIN (SELECT * FROM hd WHERE {_bounds_sql(0.5)}) y ON x.kmer = y.kmer GROUP BY 1, 2"""
)
def new2all_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = Settings(K, "aa", fraction=0.5)
    return modes.new2all(benchmark(spark, sf_dir, half), documents(spark, sf_dir, half)).select("row_id", "col_id", "common")


# ---- text -----------------------------------------------------------------------------------------------------------

_NUMBER = "(CASE WHEN {v} = 0 THEN '0' ELSE printf('%.6f', floor({v} * 1000000 + 0.5) / 1000000) END)"


@query(
    f"""{DOC_PAIRS}, cells AS (SELECT row_id, string_agg((col_id + 1)::VARCHAR || ':' || common::VARCHAR || ',', '' ORDER BY col_id) AS c FROM pairs GROUP BY 1)
SELECT n.sample_id AS at, n.sample_id::VARCHAR || ',' || n.n_kmers::VARCHAR || ',' || coalesce(c, '') AS line FROM docs_n n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT -1, 'query-samples,total-kmers,' || string_agg(n_kmers::VARCHAR || ',', '' ORDER BY sample_id) FROM docs_n
UNION ALL SELECT -2, 'kmer-length: {K} fraction: 1 ,db-samples ,' || string_agg(sample_id::VARCHAR || ',', '' ORDER BY sample_id) FROM docs_n"""
)
def sparse_row_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)
    return render.counts_lines(index.samples, index.samples, overlap.all2all(index.postings, most=index.most), K, 1.0, sparse=True)


_TRIANGLE = f"""WITH {{0}}, {{1}},
sized AS (SELECT a.sample_id AS row_id, b.sample_id AS col_id, coalesce(p.common, 0) AS common, a.n_kmers AS n_row, b.n_kmers AS n_col
  FROM {{2}}_n a JOIN {{2}}_n b ON b.sample_id < a.sample_id LEFT JOIN pairs p ON p.row_id = a.sample_id AND p.col_id = b.sample_id),
v AS (SELECT row_id, col_id, CASE WHEN n_row + n_col - common = 0 THEN 0 ELSE {_J} END AS x FROM sized)"""


@query(
    _TRIANGLE.format(sql_set("convs"), sql_pairs("pairs", "convs"), "convs")
    + f""", cells AS (SELECT row_id, string_agg({_NUMBER.format(v="x")} || ',', '' ORDER BY col_id) AS c FROM v GROUP BY 1)
SELECT n.sample_id AS at, n.sample_id::VARCHAR || ',' || coalesce(c, '') AS line FROM convs_n n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT -2, 'kmer-length: {K} fraction: 1 ,' || string_agg(sample_id::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n"""
)
def distance_dense_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = conversations(spark, sf_dir)
    sized = overlap.all2all_sized(index.postings, index.samples, index.most)
    return render.values_lines(index.samples, index.samples, select.scored(sized, "jaccard", K), K, 1.0, zeros="triangle")


@query(
    _TRIANGLE.format(sql_set("items"), sql_pairs("pairs", "items"), "items")
    + f""", cells AS (SELECT row_id, string_agg({_NUMBER.format(v="x")} || ' ', '' ORDER BY col_id) AS c FROM v GROUP BY 1)
SELECT n.sample_id AS at, n.sample_id::VARCHAR || ' ' || coalesce(c, '') AS line FROM items_n n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT -1, count(*)::VARCHAR FROM items_n"""
)
def phylip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = benchmark(spark, sf_dir)
    sized = overlap.all2all_sized(index.postings, index.samples, index.most)
    return render.phylip_lines(index.samples, select.scored(sized, "jaccard", K), "triangle")


@query(
    f"""WITH {sql_set("convs")}, {sql_pairs("pairs", "convs")},
cells AS (SELECT a.sample_id AS row_id, string_agg(coalesce(p.common, 0)::VARCHAR || ',', '' ORDER BY b.sample_id) AS c
  FROM convs_n a JOIN convs_n b ON b.sample_id < a.sample_id LEFT JOIN pairs p ON p.row_id = a.sample_id AND p.col_id = b.sample_id GROUP BY 1)
SELECT n.sample_id AS at, n.sample_id::VARCHAR || ',' || n.n_kmers::VARCHAR || ',' || coalesce(c, '') AS line FROM convs_n n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT -1, 'query-samples,total-kmers,' || string_agg(n_kmers::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n
UNION ALL SELECT -2, 'kmer-length: {K} fraction: 1 ,db-samples ,' || string_agg(sample_id::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n"""
)
def dense_counts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = conversations(spark, sf_dir)
    return render.counts_lines(index.samples, index.samples, overlap.all2all(index.postings, most=index.most), K, 1.0, zeros="triangle")


_RECTANGLE_HEAD = f"""UNION ALL SELECT -1, 'query-samples,total-kmers,' || string_agg(n_kmers::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n
UNION ALL SELECT -2, 'kmer-length: {K} fraction: 1 ,db-samples ,' || string_agg(sample_id::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n"""


def _sql_rectangle(which: str, sparse: bool) -> str:
    cell = "(b.sample_id + 1)::VARCHAR || ':' || p.common::VARCHAR" if sparse else "coalesce(p.common, 0)::VARCHAR"
    return f"""WITH {sql_set("items")}, {sql_set("convs")},
pairs AS (SELECT x.sample_id AS row_id, y.sample_id AS col_id, count(*)::BIGINT AS common FROM items x JOIN convs y ON x.kmer = y.kmer GROUP BY 1, 2),
cells AS (SELECT a.sample_id AS row_id, string_agg({cell} || ',', '' ORDER BY b.sample_id) AS c
  FROM items_n a CROSS JOIN convs_n b {"" if sparse else "LEFT "}JOIN pairs p ON p.row_id = a.sample_id AND p.col_id = b.sample_id GROUP BY 1)
SELECT n.sample_id AS at, n.sample_id::VARCHAR || ',' || n.n_kmers::VARCHAR || ',' || coalesce(c, '') AS line FROM items_n n LEFT JOIN cells ON row_id = n.sample_id WHERE {which}
{_RECTANGLE_HEAD}"""


@query(_sql_rectangle("true", True))
def new2all_sparse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, index = benchmark(spark, sf_dir), conversations(spark, sf_dir)
    return render.counts_lines(new.samples, index.samples, overlap.new2all(new.postings, index.postings, most=new.most * index.most), K, 1.0, sparse=True)


@query(_sql_rectangle("true", False))
def new2all_dense_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, index = benchmark(spark, sf_dir), conversations(spark, sf_dir)
    return render.counts_lines(new.samples, index.samples, overlap.new2all_dense(new.postings, new.samples, index.postings, index.samples), K, 1.0)


@query(_sql_rectangle("n.sample_id = 0", False))
def one2all_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, index = first_item(spark, sf_dir), conversations(spark, sf_dir)
    return render.counts_lines(one.samples, index.samples, modes.one2all(one, index), K, 1.0)


# ---- files ----------------------------------------------------------------------------------------------------------


def counts_file(spark: SparkSession, sf_dir: str, sparse: bool) -> str:
    """A table of the counts of all conversations, as compressed files."""
    path, index = work_path(spark, "counts"), conversations(spark, sf_dir)
    pairs = overlap.all2all(index.postings, most=index.most)
    render.write_lines(render.counts_lines(index.samples, index.samples, pairs, K, 1.0, sparse, None if sparse else "triangle"), path, ordered=True, compression="gzip")
    return path


def stored_at(spark: SparkSession, sf_dir: str, name: str, sample: str) -> str:
    """The folder of a table's stored index."""
    path = work_path(spark, name)
    store.build_stored(spark, path, *texts(spark, sf_dir, name, sample), AA)
    return path


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _lines_sql(name: str) -> str:
    return f"SELECT line FROM ({ORACLES[name]})"


@query(_lines_sql("dense_counts_table"))
def all2all_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index to a written dense table, in one call."""
    target = work_path(spark, "all2all")
    files.all2all(spark, stored_at(spark, sf_dir, "conversations", "conv_id"), target, compression="gzip")
    return lines_of(spark, target)


def _sql_sparse_lines(source: str, names: str, where: str) -> str:
    """Lines of a sparse table of the pairs of ``source``, of which ``names`` has (sample_id, name, n_kmers)."""
    return f"""{sql_pairs("pairs", source)}, {sql_sized("sized", "pairs", source, source)},
cells AS (SELECT row_id, string_agg((col_id + 1)::VARCHAR || ':' || common::VARCHAR || ',', '' ORDER BY col_id) AS c FROM sized WHERE {where} GROUP BY 1)
SELECT n.name || ',' || n.n_kmers::VARCHAR || ',' || coalesce(c, '') AS line FROM {names} n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT 'query-samples,total-kmers,' || string_agg(n_kmers::VARCHAR || ',', '' ORDER BY sample_id) FROM {names}
UNION ALL SELECT 'kmer-length: {K} fraction: 1 ,db-samples ,' || string_agg(name || ',', '' ORDER BY sample_id) FROM {names}"""


@query(f"WITH {sql_set('convs')}, named AS (SELECT *, sample_id::VARCHAR AS name FROM convs_n), {_sql_sparse_lines('convs', 'named', f'{_M} >= 0.05 AND common >= 3')}")
def all2all_sparse_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index to a written sparse table, with bounds given as texts."""
    target = work_path(spark, "all2all")
    files.all2all(spark, stored_at(spark, sf_dir, "conversations", "conv_id"), target, sparse=True, at_least=["min:0.05", "3"], compression="gzip")
    return lines_of(spark, target)


@query(
    f"""{_BOTH}, named AS (SELECT *, sample_id::VARCHAR AS name FROM convs_n UNION ALL SELECT sample_id + d, n_kmers, sample_id::VARCHAR FROM items_n, shift),
{_sql_sparse_lines("every", "named", f"{_M} <= 0.9")}"""
)
def all2all_parts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored indexes that a list file names to one written table."""
    target, listed = work_path(spark, "parts"), work_path(spark, "list")
    paths = [stored_at(spark, sf_dir, *source) for source in (("conversations", "conv_id"), ("benchmark", "item_id"))]
    spark.createDataFrame([(" ".join(paths),)], "value string").coalesce(1).write.text(listed)
    files.all2all_parts(spark, listed, target, at_most=["min:0.9"], compression="gzip")
    return lines_of(spark, target)


@query(_lines_sql("new2all_sparse_table"))
def new2all_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index and gzip FASTA files, each record a sample, to a written sparse table."""
    target = work_path(spark, "new2all")
    files.new2all(spark, stored_at(spark, sf_dir, "conversations", "conv_id"), item_files(spark, sf_dir), target, "multisample-fasta", sparse=True)
    return lines_of(spark, target)


@query(_lines_sql("one2all_table"))
def one2all_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index and a table of the words of one sample to a written table."""
    target, words = work_path(spark, "one2all"), work_path(spark, "words")
    one = first_item(spark, sf_dir)
    one.samples.join(one.postings, "sample_id", "left").select("name", "kmer").write.parquet(words)  # an item may have no word
    files.one2all(spark, stored_at(spark, sf_dir, "conversations", "conv_id"), words, target, "words")
    return lines_of(spark, target)


@query(f"WITH {sql_set('convs')}, {sql_pairs('pairs', 'convs')} SELECT {_PAIR} FROM pairs")
def counts_reader_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_counts_table(spark, counts_file(spark, sf_dir, False)).pairs


@query(f"WITH {sql_set('convs')}, {sql_pairs('pairs', 'convs')} SELECT {_PAIR} FROM pairs")
def counts_reader_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_counts_table(spark, counts_file(spark, sf_dir, True)).pairs


@query(
    f"""WITH {sql_set("convs")}, {sql_pairs("pairs", "convs")}, {sql_sized("sized", "pairs", "convs", "convs")},
cells AS (SELECT row_id, string_agg((col_id + 1)::VARCHAR || ':' || {_NUMBER.format(v=SQL_MEASURES["mash"])} || ',', '' ORDER BY col_id) AS c FROM sized WHERE {_M} >= 0.01 AND {SQL_MEASURES["mash"]} <= 0.9 GROUP BY 1)
SELECT n.sample_id::VARCHAR || ',' || coalesce(c, '') AS line FROM convs_n n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT 'kmer-length: {K} fraction: 1 ,' || string_agg(sample_id::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n"""
)
def distance_sparse_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a sparse table of counts to one of values, file to file; the bound without a name is for the measure."""
    target = work_path(spark, "values")
    modes.distance(spark, counts_file(spark, sf_dir, True), target, "mash", "gzip", at_least=["min:0.01"], at_most=["0.9"])
    return spark.read.text(target).withColumnRenamed("value", "line")


@query(
    _TRIANGLE.format(sql_set("convs"), sql_pairs("pairs", "convs"), "convs")
    + f""", cells AS (SELECT row_id, string_agg({_NUMBER.format(v="x")} || ',', '' ORDER BY col_id) AS c FROM v GROUP BY 1)
SELECT n.sample_id::VARCHAR || ',' || coalesce(c, '') AS line FROM convs_n n LEFT JOIN cells ON row_id = n.sample_id
UNION ALL SELECT 'kmer-length: {K} fraction: 1 ,' || string_agg(sample_id::VARCHAR || ',', '' ORDER BY sample_id) FROM convs_n"""
)
def distance_dense_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the lower triangle of counts to that of values, file to file."""
    target = work_path(spark, "values")
    modes.distance(spark, counts_file(spark, sf_dir, False), target, "jaccard", "gzip")
    return spark.read.text(target).withColumnRenamed("value", "line")


@query(ORACLES["distance_dense_file"])
def distance_dense_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds are for sparse tables: a dense one has every cell, whatever they are."""
    target = work_path(spark, "values")
    modes.distance(spark, counts_file(spark, sf_dir, False), target, "jaccard", "gzip", at_least=["0.9"], at_most=["num-kmers:1"])
    return spark.read.text(target).withColumnRenamed("value", "line")


def item_files(spark: SparkSession, sf_dir: str) -> str:
    """A list file of FASTA files, with a record for each benchmark item; gzip files, of which the list leaves out the ending."""
    path = work_path(spark, "fasta")
    text = F.translate("text", "\r\n>", "...")  # no letters, so that no word crosses them
    record = F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit(" item\n"), text)
    table(spark, sf_dir, "benchmark").repartition(2, "item_id").select(record).write.option("compression", "gzip").text(f"{path}/files")
    names = [n for n in children(spark, f"{path}/files") if n.endswith(".txt.gz")]
    spark.createDataFrame([(f"{path}/files/{n.removesuffix('.gz')}",) for n in names], "value string").coalesce(1).write.text(f"{path}/list")
    return f"{path}/list"


@query(f"WITH {sql_set('items')} SELECT sample_id::VARCHAR AS name, n_kmers FROM items_n")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample for each record of some gzip FASTA files."""
    return read_samples(spark, item_files(spark, sf_dir), AA, "multisample-fasta").samples.select("name", "n_kmers")


@query(f"WITH {sql_set('items')} SELECT sample_id::VARCHAR AS name, kmer FROM items")
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample for each file: the words of each, by the item that its file is named after. Text before a record is no part of it."""
    path = work_path(spark, "fasta")
    text = F.translate("text", "\r\n>", "...")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("ACDEFGHIKLMNPQRSTVWY no record\n>first\n"), text).alias("value"))
    items.write.partitionBy("item_id").text(f"{path}/files")
    folders = [n for n in children(spark, f"{path}/files") if n.startswith("item_id=")]
    files = [f"{path}/files/{d}/{n}" for d in folders for n in children(spark, f"{path}/files/{d}") if n.endswith(".txt")]
    spark.createDataFrame([(f,) for f in files], "value string").coalesce(1).write.text(f"{path}/list")
    index = read_samples(spark, f"{path}/list", AA)
    # a file is named by Spark's writer, its folder by the item; samples have the list's order
    listed = [r.value for r in spark.read.text(f"{path}/list").collect()]
    names = spark.createDataFrame([(k, f.rsplit("/", 2)[-2].removeprefix("item_id=")) for k, f in enumerate(listed)], "sample_id long, name string")
    return spelled(index.postings, AA).join(names, "sample_id").select("name", "kmer")


@query(f"WITH {sql_set('items', Settings(6, 'aa'))}, {sql_hashed('hashed', 'items', Settings(6, 'aa'))} SELECT sample_id::VARCHAR AS name, kmer FROM hashed WHERE {_bounds_sql(0.25)}")
def sketch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch files of words that are stored spread out, written and read back."""
    settings, folder = Settings(6, "aa", fraction=0.25), work_path(spark, "sketches")
    modes.sketch(*texts(spark, sf_dir, "benchmark", "item_id"), folder, settings)
    names = [n for n in children(spark, folder) if n.endswith(".minhash")]
    spark.createDataFrame([(f"{folder}/{n.removesuffix('.minhash')}",) for n in names], "value string").coalesce(1).write.text(f"{folder}-list")
    index = read_samples(spark, f"{folder}-list", settings, "sketch")
    return spelled(index.postings, settings).join(index.samples, "sample_id").select("name", "kmer")
