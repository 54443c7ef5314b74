"""Groups of near-duplicate texts at a Jaccard similarity of word shingles: operator 9's stage at five words and 0.8.

At that similarity about 15 % of a SimHash fingerprint's bits differ. Golay keys that tolerate so many are either too
short to be selective or too many, so candidates come from the least hashes of the shingles (MinHash) in place of
fingerprint segments; the rest is as in ``simhash``: keys, a join, a verification of every pair, components.

A text's set holds the hashes of its distinct shingles. ``BANDS`` keys are made of ``ROWS`` least hashes each. Two texts of
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8. Pairs that share one are compared
whole set against whole set, in integers, so no link is false (but for equal 64-bit hashes of different shingles).

No group is expanded into its pairs. A round takes leaders of each key, compares them with the key's texts that are not
in their component yet, and finds the components anew. A leader has then met all of its key and leaves it. A key whose
texts are of one component is done. So each two texts that share a key are either compared or in one component, which
gives the same components as all pairs would; a group of copies takes one comparison a text. Leaders a key grow
fourfold a round, so that rounds are few also where a key's texts are unlike each other.

Defined results: null and blank texts have no words, and are alike. Texts of fewer words than a shingle are one shingle,
the whole sequence. Rows that repeat a doc_id are rows of their own. A null doc_id is kept; its component is the smallest
doc_id of its group, if there is one. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .joins import maybe_among, salted_join
from .store import settle

WORDS = 5
PERCENT = 80
SEED = 42
BANDS = 20
ROWS = 5
#: Shingles whose least hashes are sought at once.
CHUNK = 1 << 10
#: Hashes in a batch that a task hands over.
BATCH_HASHES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    n = max(1, len(words) - size + 1)
    single = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = _mix(out ^ single[i : i + n])
    return np.unique(out)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values * _ODD
    values ^= values >> _SHIFT
    return values * _ODD


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key a band, of the band's number and its least hashes."""
    draw = np.random.default_rng(SEED)
    flips = draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
    factors = draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[at : at + CHUNK, None] ^ flips) * factors).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys ^ column)
    return keys.view(np.int64)


def _mark():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, n, keys): mark is the text's MD5, n its number of distinct shingles, keys one a band."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, BANDS), np.int64)
            for i, text in enumerate(b.column(2)):
                hashes = shingle_hashes(text.as_py(), words)
                sizes[i], keys[i] = len(hashes), band_keys(hashes)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), lists], ["doc_id", "mark", "n", "keys"])

    return docs.select("doc_id", _mark().alias("mark"), "text").mapInArrow(each, f"doc_id {kind}, mark binary, n long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(mark, hashes) of each document."""

    def batch(marks: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), lists], ["mark", "hashes"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, sets, held = [], [], 0
            for mark, text in zip(b.column(0), b.column(1), strict=True):
                marks.append(mark.as_py())
                sets.append(shingle_hashes(text.as_py(), words))
                held += len(sets[-1])
                if held >= BATCH_HASHES:
                    yield batch(marks, sets)
                    marks, sets, held = [], [], 0
            if marks:
                yield batch(marks, sets)

    return docs.select(_mark().alias("mark"), "text").mapInArrow(each, "mark binary, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are at least so similar. A text in many pairs is dealt to many tasks."""
    for end in ("a", "b"):
        mine = sets.select(F.col("mark").alias(end), F.col("hashes").alias(f"_{end}"))
        weights = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_weight"))
        pairs = salted_join(pairs, mine, end, "_weight", F.col("b" if end == "a" else "a"), weights=weights).drop("_salt", "_salts")
        if end == "a":
            pairs = pairs.select("a", "b", "_a")
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.where(100 * both >= percent * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def links(nodes: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the texts that have a partner; ``nodes`` (mark, n, keys) has a row a distinct text."""
    keyed = nodes.select("mark", "n", F.explode("keys").alias("key"))
    counts = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_weight")).where("_weight > 1"), "keys")
    left = salted_join(keyed, counts, "key", "_weight", F.col("mark")).select("key", "mark", "n", F.col("mark").alias("component"))
    left = settle(left, "met")
    candidates = settle(left.select("mark").distinct(), "candidates")
    flagged = maybe_among(docs.select("text", _mark().alias("_of")), F.col("_of"), candidates, "mark").where("_maybe").select("text")
    sets = shingle_sets(flagged, words).join(candidates, "mark", "left_semi")
    sets = settle(sets.groupBy("mark").agg(F.any_value("hashes").alias("hashes")), "sets")
    found = left.select(F.col("mark").alias("node"), "component").limit(0)
    linked, leaders, weights = [], 1, counts
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("mark"))
        lead = left.withColumn("_place", place).where(F.col("_place") <= leaders)
        lead = settle(lead.select("key", F.col("mark").alias("_by"), F.col("n").alias("_n"), F.col("component").alias("_in")), "leaders")
        met = salted_join(left, lead, "key", "_weight", F.col("mark"), weights=weights).where("component <> _in")
        met = met.where(100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"))
        pairs = settle(met.select(F.least("mark", "_by").alias("a"), F.greatest("mark", "_by").alias("b")).distinct(), "pairs")
        fresh = settle(verified(pairs, sets, percent), "links")
        if not fresh.isEmpty():
            linked.append(fresh)
            found = components(reduce(DataFrame.unionAll, linked))
        rest = left.drop("component").join(lead.select("key", F.col("_by").alias("mark")), ["key", "mark"], "left_anti")
        rest = rest.join(found.select(F.col("node").alias("mark"), "component"), "mark", "left")
        rest = settle(rest.select("key", "mark", "n", F.coalesce("component", "mark").alias("component")), "rest")
        open_keys = rest.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_weight"))
        weights = settle(open_keys.where("_low <> _high").select("key", "_weight"), "open")
        left = settle(salted_join(rest, weights, "key", "_weight", F.col("mark")).select("key", "mark", "n", "component"), "met")
        leaders *= 4
    return found


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, mark (hex), fingerprint (the mark that names its group) and component_id, the group's smallest doc_id."""
    seen = settle(signatures(docs, words), "signatures")
    nodes = seen.groupBy("mark").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    nodes = settle(nodes, "nodes")
    found = links(nodes, docs, words, percent)
    of = nodes.join(found.select(F.col("node").alias("mark"), "component"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    of = settle(of.select("mark", "rows", "first", "component"), "components")
    least = of.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("_n"))
    named = salted_join(of, least, "component", "_n", F.col("mark")).select("mark", "rows", "component", "least")
    met = salted_join(seen.select("doc_id", "mark"), settle(named, "named"), "mark", "rows", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return met.select("doc_id", F.lower(F.hex("mark")).alias("mark"), F.lower(F.hex("component")).alias("fingerprint"), F.col("least").alias("component_id"))
