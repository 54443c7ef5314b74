"""How many words samples share: all against all, new against an index, one against an index, index against index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .select import with_sizes

#: A word in more samples than this is joined with itself in chunks of as many, and one that makes more than its square of
#: pairs between two indexes is joined in a grid of them.
CHUNK = 4_000
#: From this share of the larger set, or this many words, that pairs must have in common, they are sought by prefixes: below
#: them, prefixes hold most postings, and the plain join costs less than what is looked up after it.
WORTHWHILE_SHARE, WORTHWHILE_WORDS = 0.3, 16
#: Pairs of postings from which they are counted in a grid of blocks, if that costs less; beside prefixes, which make few
#: of these pairs; and samples of a block where every pair is asked for.
GRID_PAIRS, GRID_PREFIX_PAIRS, GRID_SAMPLES = 1 << 24, 1 << 26, 1 << 13
#: Searches for a posting's word in a block that cost as much as joining, shuffling and grouping one pair of postings.
SEARCHES = 8
#: Classes of frequency an octave. Words in up to 16 samples have a class a number.
_CLASSES, _EXACT_CLASSES = 8, 16


def _self_join(post: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Rows (row_id, col_id, ...) of each pair of postings that agree in ``keys``, with col_id < row_id."""
    x = post.select(*keys, F.col("sample_id").alias("row_id"), *[F.col(c).alias(f"row_{c}") for c in carried])
    y = post.select(*keys, F.col("sample_id").alias("col_id"), *[F.col(c).alias(f"col_{c}") for c in carried])
    return x.join(y, keys).where("col_id < row_id").drop(*keys)


def _chunked_join(post: DataFrame, frequent: DataFrame, carried: list[str], chunk: int) -> DataFrame:
    """The same for frequent words (kmer, _n): a word's samples are dealt to chunks, and each pair of chunks is a key."""
    many = post.join(frequent, "kmer").withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("int"))
    mine = many.withColumn("_own", F.pmod(F.xxhash64("sample_id"), F.col("_chunks")).cast("int"))
    # every sample goes to the keys of its chunk with each other one; within a chunk to one key
    keyed = mine.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    keyed = keyed.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
    pairs = _self_join(keyed, ["kmer", "_low", "_high"], ["_own", "_other", *carried])
    # a pair of one chunk meets at every key of that chunk, and counts at its own
    own = (F.col("row__own") != F.col("col__own")) | (F.col("row__own") == F.col("row__other"))
    return pairs.where(own).drop("row__own", "col__own", "row__other", "col__other")


def _pairs(post: DataFrame, carried: list[str], chunk: int, most: int | None) -> DataFrame:
    """A row (row_id, col_id, ...) for each word of each pair. Words in more than ``chunk`` samples are joined apart, by many
    tasks each; whether there are any is counted, unless ``most`` says that there are none."""
    if most is not None and most <= chunk:
        return _self_join(post, ["kmer"], carried)
    frequent = post.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    if frequent.isEmpty():
        return _self_join(post, ["kmer"], carried)
    rare = post.join(frequent.select("kmer"), "kmer", "left_anti")
    return _self_join(rare, ["kmer"], carried).unionByName(_chunked_join(post, frequent, carried, chunk))


def grid_blocks(post: DataFrame, most: int | None = None, pairs: int | None = None, words: DataFrame | None = None) -> tuple[int, int | None]:
    """(blocks, most): the blocks of a grid for the pairs of postings, 0 where joining by word costs less or makes fewer than
    ``pairs``, and the most samples of a word. ``words`` (_n) are the numbers of samples, if they are known."""
    asked = GRID_PAIRS if pairs is None else pairs
    if most is not None and (most < 2 or post.count() * most < 2 * asked):
        return 0, most
    words = post.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")) if words is None else words
    made = F.sum(F.col("_n") * (F.col("_n") - 1) / 2)  # a double: there may be more than a long holds
    rows, found, top = words.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(made, F.lit(0.0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    blocks = grid.number_of_blocks(rows)
    return (blocks if found >= asked and SEARCHES * found > rows * blocks else 0), top


def all2all(post: DataFrame, chunk: int = CHUNK, most: int | None = None, runs: bool = False) -> DataFrame:
    """(row_id, col_id, common) for each pair with col_id < row_id that shares a word.

    The two sides of the join are one shuffle on the word, or none where postings lie bucketed by it. No word is in more
    than ``most`` samples, if that is given. Where the join would cost more than a grid of blocks, pairs are counted
    in that, and come in ``runs`` if these are asked for.
    """
    blocks, most = grid_blocks(post, most)
    if blocks:
        return grid.counted(post, blocks, runs=runs, sizes=False)
    return _joined_pairs(post, chunk, most)


def all2all_sized(
    post: DataFrame, samples: DataFrame, most: int | None = None, share: float = 0.0, least: int = 0, best: int | None = None, runs: bool = False, seed: int | None = None
) -> DataFrame:
    """The same with n_row and n_col, the sizes of both, which the grid has at hand. It leaves out pairs that don't share ``share``
    and ``least``, or that aren't among the ``best`` of any sample (with a ``seed``: the ``random_of_rows``), and hands them
    over in ``runs``, as ``grid.counted`` has it; the join leaves out none, in no order."""
    blocks, most = grid_blocks(post, most)
    return grid.counted(post, blocks, None, share, least, best=best, runs=runs, seed=seed) if blocks else with_sizes(_joined_pairs(post, CHUNK, most), samples)


def _joined_pairs(post: DataFrame, chunk: int, most: int | None) -> DataFrame:
    return _pairs(post.select("kmer", "sample_id"), [], chunk, most).groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("common"))


def _with_class(post: DataFrame) -> DataFrame:
    """Postings of words in two samples or more, with the class of their frequency."""
    counts = post.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    above = _EXACT_CLASSES + F.floor(F.log2(F.col("_n") / _EXACT_CLASSES) * _CLASSES)
    kind = F.when(F.col("_n") <= _EXACT_CLASSES, F.col("_n")).otherwise(above).cast("int")
    return post.select("kmer", "sample_id").join(counts.select("kmer", kind.alias("_class")), "kmer")


def prefixes(post: DataFrame, sizes: DataFrame, share: float, least: int = 0) -> DataFrame:
    """(kmer, sample_id, _class, size, cut, rest): words that some other sample has too, with their sample's cut.

    Words are in an order of their frequency, by classes. If a sample must share ``share`` of its words with another, and
    ``least`` at least, one of these is among its first ``size - needed + 1``: those of class ``cut`` at most, its prefix.
    ``rest`` words follow. Samples whose prefix no other sample shares are left out. A sample has a row a class where cuts
    are sought, so no group is large.
    """
    words = _with_class(post)
    counts = words.groupBy("sample_id", "_class").agg(F.count(F.lit(1)).alias("_words"))
    upto = Window.partitionBy("sample_id").orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_words").over(upto)).withColumn("_all", F.sum("_words").over(Window.partitionBy("sample_id")))
    # a little less than asked, so that rounding here never drops a pair that the exact filter keeps
    needed = F.greatest(F.ceil(F.col("n_kmers") * F.lit(share * (1 - 1e-9))), F.lit(max(1, least)))
    sized = counts.join(sizes.where(F.col("n_kmers") >= max(1, least)).select("sample_id", "n_kmers"), "sample_id")
    # words that no other sample has come first in the order; they are in no row here
    first = F.col("n_kmers") - needed + 1 - (F.col("n_kmers") - F.col("_all"))
    reached = sized.withColumn("_first", first).where("_first > 0 and _upto >= _first")
    cuts = reached.groupBy("sample_id").agg(F.first("n_kmers").alias("size"), F.min("_class").alias("cut"), F.min(F.struct("_class", (F.col("_all") - F.col("_upto")).alias("rest")))["rest"].alias("rest"))
    return words.join(cuts, "sample_id")


def all2all_sharing(post: DataFrame, sizes: DataFrame, share: float, least: int = 0, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """(row_id, col_id, common, n_row, n_col) of every pair that has ``share`` of the larger set, and ``least`` words, in common.
    Some more pairs may be among them, with right counts too.

    Only prefixes are joined with each other: frequent words, which make most pairs, are in few of them. What a pair shares
    there, and the words after the prefix that ends first, bound what it can share at all. Of pairs for which that is
    enough, these words are looked up in the other sample.
    """
    marked = prefixes(post, sizes, share, least)
    found = _pairs(marked.where("_class <= cut"), ["size", "cut", "rest"], chunk, most)
    slack = F.lit(share * (1 - 1e-9))
    found = found.where(F.least("row_size", "col_size") >= F.greatest("row_size", "col_size") * slack)
    keys = ["row_id", "col_id", "row_size", "col_size", "row_cut", "col_cut", "row_rest", "col_rest"]
    seen = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
    row_first = F.col("row_cut") <= F.col("col_cut")
    seen = seen.withColumn("_rest", F.when(F.col("row_cut") == F.col("col_cut"), F.least("row_rest", "col_rest")).when(row_first, F.col("row_rest")).otherwise(F.col("col_rest")))
    needed = F.greatest(F.greatest("row_size", "col_size") * slack, F.lit(float(least)))
    seen = seen.where(F.col("_seen") + F.col("_rest") >= needed)
    seen = seen.select("row_id", "col_id", "_seen", "row_size", "col_size", F.when(row_first, F.col("row_id")).otherwise(F.col("col_id")).alias("_one"), F.when(row_first, F.col("col_id")).otherwise(F.col("row_id")).alias("_other"))
    after = marked.where("_class > cut").select(F.col("sample_id").alias("_one"), "kmer")
    other = marked.select(F.col("sample_id").alias("_other"), "kmer")
    looked = seen.select("row_id", "col_id", "_one", "_other").join(after, "_one").join(other, ["_other", "kmer"], "left_semi")
    more = looked.groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("_more"))
    out = seen.join(more, ["row_id", "col_id"], "left")
    return out.select("row_id", "col_id", (F.col("_seen") + F.coalesce("_more", F.lit(0))).alias("common"), F.col("row_size").alias("n_row"), F.col("col_size").alias("n_col"))


def cells(rows: DataFrame, columns: DataFrame, triangular: bool) -> DataFrame:
    """(row_id, col_id) of every cell of a matrix, or of its lower triangle: as many rows as the dense output has values."""
    a, b = rows.select(F.col("sample_id").alias("row_id")), columns.select(F.col("sample_id").alias("col_id"))
    return a.join(b, F.col("col_id") < F.col("row_id")) if triangular else a.crossJoin(b)


def all2all_dense(post: DataFrame, samples: DataFrame) -> DataFrame:
    """(row_id, col_id, common) for every pair with col_id < row_id, zeros included. Many pairs are counted in a grid."""
    blocks = -(-samples.count() // GRID_SAMPLES)
    if blocks > 1:
        blocks = max(blocks, grid.number_of_blocks(post.count()))
        return grid.counted(post, blocks, samples, sizes=False)
    every = cells(samples, samples, True)
    return every.join(all2all(post), ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("common", F.lit(0)).alias("common"))


def _names(post: DataFrame, bits: int) -> DataFrame:
    """(kmer, _n, _x1, _x2): a name of the set of samples of each word, from their number and ``bits`` bits of order-free hash a
    half. It is made before the shuffle as far as it goes, so a frequent word makes no long row."""
    mask = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")
    marks = [F.bit_xor(F.xxhash64("sample_id", F.lit(seed)).bitwiseAND(mask)).alias(f"_x{seed}") for seed in (1, 2)]
    return post.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"), *marks)


def pattern_words(post: DataFrame, bits: int = 64) -> DataFrame:
    """(kmer, pattern, n_samples, num_kmers): for each word, the least word that occurs in just the same samples, how many samples
    these are, and how many words occur in them.

    Sets of samples are told apart by name. Whether words of one name have one set is then counted: every sample of a name's
    words must have all of them. Words of names for which that fails, which two sets share, are grouped by whole lists of
    their samples; with 128 bits there are none to be expected.
    """
    names = ["_n", "_x1", "_x2"]
    named = _names(post, bits)
    same = named.groupBy(*names).agg(F.count(F.lit(1)).alias("num_kmers"), F.min("kmer").alias("pattern"))
    words = named.join(same, names).select("kmer", "pattern", F.col("_n").alias("n_samples"), "num_kmers")
    # of one set: each of its samples has every word of the name
    several = words.where("num_kmers > 1").select("kmer", "pattern", "num_kmers")
    held = post.select("kmer", "sample_id").join(several, "kmer").groupBy("pattern", "sample_id").agg(F.count(F.lit(1)).alias("_held"), F.first("num_kmers").alias("_all"))
    met = held.where("_held <> _all").select("pattern").distinct()
    clear = words.join(met, "pattern", "left_anti")
    lists = post.select("kmer", "sample_id").join(words.join(met, "pattern", "left_semi").select("kmer"), "kmer").groupBy("kmer").agg(F.array_sort(F.collect_list("sample_id")).alias("_samples"))
    told = lists.groupBy("_samples").agg(F.collect_list("kmer").alias("_words"))
    apart = told.select(F.explode("_words").alias("kmer"), F.array_min("_words").alias("pattern"), F.size("_samples").cast("long").alias("n_samples"), F.size("_words").cast("long").alias("num_kmers"))
    return clear.select(*apart.columns).unionByName(apart)


def pattern_members(post: DataFrame, bits: int = 64) -> DataFrame:
    """(pattern, sample_id, n_samples, num_kmers): the samples of each pattern, once, a row a sample."""
    leads = pattern_words(post, bits).where("kmer = pattern")
    return post.select("kmer", "sample_id").join(leads, "kmer").select("pattern", "sample_id", "n_samples", "num_kmers")


def patterns(post: DataFrame) -> DataFrame:
    """(samples, num_kmers): for each set of samples, how many words occur in just those. A set is one value here; for large
    ones take ``pattern_members``."""
    sets = pattern_members(post).groupBy("pattern").agg(F.array_sort(F.collect_list("sample_id")).alias("samples"), F.first("num_kmers").alias("num_kmers"))
    return sets.select("samples", "num_kmers")


def all2all_by_patterns(post: DataFrame, chunk: int = CHUNK, most: int | None = None, runs: bool = False) -> DataFrame:
    """The same as ``all2all``, by way of patterns: worthwhile where many words occur in the same samples. Each pair of a
    pattern's samples counts for all its words; large patterns are joined in chunks, as frequent words are."""
    members = pattern_members(post).where("n_samples > 1").select(F.col("pattern").alias("kmer"), "sample_id", "num_kmers")
    if most is None or most > 1:
        leads = pattern_words(post).where("kmer = pattern and n_samples > 1")
        blocks, most = grid_blocks(members, None, words=leads.select(F.col("n_samples").alias("_n")))
        if blocks:
            return grid.counted(members, blocks, weight="num_kmers", runs=runs, sizes=False)
    return _pairs(members, ["num_kmers"], chunk, most).groupBy("row_id", "col_id").agg(F.sum("row_num_kmers").alias("common"))


def one_of_parts(parts: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(samples, postings) of partial indexes (samples, postings): ids are the parts' ids, each part after the other."""
    every_sample, every_posting, offset = None, None, 0
    for samples, post in parts:
        moved = samples.withColumn("sample_id", F.col("sample_id") + F.lit(offset))
        words = post.withColumn("sample_id", F.col("sample_id") + F.lit(offset))
        every_sample = moved if every_sample is None else every_sample.unionByName(moved)
        every_posting = words if every_posting is None else every_posting.unionByName(words)
        offset += (samples.agg(F.max("sample_id")).first()[0] or 0) + 1
    if every_sample is None:
        raise ValueError("there are no parts")
    return every_sample, every_posting


def all2all_parts(parts: Sequence[tuple[DataFrame, DataFrame]], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, pairs) over partial indexes (samples, postings)."""
    samples, post = one_of_parts(parts)
    return samples, all2all(post, most=most)


def _grid_join(x: DataFrame, y: DataFrame, frequent: DataFrame, chunk: int) -> DataFrame:
    """(row_id, col_id) for frequent words (kmer, _rows, _cols): both sides are dealt to chunks, and each cell of the grid of
    chunks is a key. A row goes to the cells of its chunk, one for each chunk of the other side."""

    def dealt(side: DataFrame, sample: str, own: str, other: str) -> DataFrame:
        many = side.join(frequent, "kmer").withColumn("_row_chunks", F.ceil(F.col("_rows") / chunk)).withColumn("_col_chunks", F.ceil(F.col("_cols") / chunk))
        mine = many.withColumn(f"_{own}", F.pmod(F.xxhash64(sample), F.col(f"_{own}_chunks")))
        return mine.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}_chunks") - 1))).select("kmer", "_row", "_col", sample)

    return dealt(x, "row_id", "row", "col").join(dealt(y, "col_id", "col", "row"), ["kmer", "_row", "_col"]).select("row_id", "col_id")


def cross(queries: DataFrame, index: DataFrame, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """(row_id, col_id, common) between two sets of postings: the whole rectangle's cells that aren't zero.

    A word that makes more pairs than ``chunk`` squared is joined apart, in a grid of chunks set by its frequency on both
    sides. Whether there are any is counted, unless ``most`` says that no word makes as many pairs.
    """
    x = queries.select("kmer", F.col("sample_id").alias("row_id"))
    y = index.select("kmer", F.col("sample_id").alias("col_id"))
    pairs = None
    if most is None or most > chunk * chunk:
        rows, cols = (side.groupBy("kmer").agg(F.count(F.lit(1)).alias(n)) for side, n in ((x, "_rows"), (y, "_cols")))
        frequent = rows.join(cols, "kmer").where(F.col("_rows") * F.col("_cols") > chunk * chunk)
        if not frequent.isEmpty():
            rare = x.join(frequent.select("kmer"), "kmer", "left_anti")
            pairs = rare.join(y, "kmer").select("row_id", "col_id").unionByName(_grid_join(x, y, frequent, chunk))
    pairs = x.join(y, "kmer") if pairs is None else pairs
    return pairs.groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("common"))


def new2all(queries: DataFrame, index: DataFrame, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    return cross(queries, index, chunk, most)


def new2all_dense(queries: DataFrame, query_samples: DataFrame, index: DataFrame, index_samples: DataFrame) -> DataFrame:
    """All cells of the rectangle, zeros included."""
    every = cells(query_samples, index_samples, False)
    return every.join(cross(queries, index), ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("common", F.lit(0)).alias("common"))


def one2all(query: DataFrame, index: DataFrame, index_samples: DataFrame) -> DataFrame:
    """(sample_id, common) of one sample's words (kmer) with every sample of the index, zeros included."""
    counts = index.join(query.select("kmer"), "kmer", "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("common"))
    return index_samples.select("sample_id").join(counts, "sample_id", "left").select("sample_id", F.coalesce("common", F.lit(0)).alias("common"))


def lookup(index: DataFrame, kmers: DataFrame) -> DataFrame:
    """(kmer, n_samples) for each of some words, 0 for those that aren't in the index."""
    found = index.join(kmers.select("kmer"), "kmer", "left_semi").groupBy("kmer").agg(F.count(F.lit(1)).alias("n_samples"))
    return kmers.select("kmer").distinct().join(found, "kmer", "left").select("kmer", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))
