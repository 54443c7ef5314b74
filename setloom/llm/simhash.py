"""Near-duplicates by SimHash, found with Golay-code fuzzy keys.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits. The binary Golay code of length 23 is perfect:
every 23-bit word lies within 3 errors of one codeword. Decoding a segment and each of its one-bit neighbours
gives the indices of the codewords nearby: one, or up to six. Words that differ in one bit at most share an index.

Two fingerprints that differ in two bits at most have, by pigeonhole, a pair of segments with one error between them:
one segment is equal and the other has an error at most. So a key is (which two segments, the raw bits of the equal
one, a codeword index of the other), and fingerprints that link meet at one key at least. Pairs that meet are verified
by their Hamming distance. Work is on distinct fingerprints.

At keys with many fingerprints no pairs are made. Their fingerprints are linked through hubs instead: a
fingerprint and its 64 one-bit neighbours are 65 hubs, and two fingerprints share a hub if and only if they differ
in two bits at most. Hubs are nodes of the graph whose components are sought, so this is exact.

Defined results: null and blank texts have the fingerprint zero, linked like any other. Texts of one or two words have
one shingle, the whole sequence. Rows that repeat a doc_id are rows of their own. A null doc_id is kept; its component
is that of its fingerprint. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .joins import maybe_among, salted_join
from .store import settle

SEED = 42
#: (first bit, number of bits) of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Fingerprints at one key from which hubs replace pairs.
PAIR_LIMIT = 32
#: Shingles that are hashed and summed at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text over its word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n, ones, hashes = max(1, len(words) - size + 1), np.zeros(64, np.int64), []
    digest = xxhash.xxh64_intdigest
    for s in shingles:
        hashes.append(digest(s, SEED))
        if len(hashes) == CHUNK:
            ones += _bit_sums(hashes)
            hashes = []
    if hashes:
        ones += _bit_sums(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _bit_sums(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp) of each document; mark is the MD5 of its text, fp the fingerprint's bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.view(np.int64))], ["doc_id", "mark", "fp"])

    return docs.select("doc_id", _mark(F.col("text")).alias("mark"), "text").mapInArrow(each, f"doc_id {kind}, mark string, fp long")


def _mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _remainder(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word, as a polynomial, by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _leaders() -> np.ndarray:
    """The error of weight 3 at most that belongs to each of the 2,048 remainders."""
    ones = [1 << i for i in range(23)]
    errors = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]
    errors = np.array(errors, np.int64)
    out = np.zeros(2048, np.int64)
    out[_remainder(errors)] = errors
    return out


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the index of the codeword it decodes to, then those of its one-bit neighbours: (n, 24)."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23, dtype=np.int64))], axis=1)
    return (near ^ _leaders()[_remainder(near)]) >> 11  # the code is systematic: its upper 12 bits name a codeword


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of every key of every fingerprint, each once."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i, fuzzy in enumerate(parts):
        indices = np.sort(codeword_indices(fuzzy), axis=1)
        fresh = np.ones(indices.shape, bool)
        fresh[:, 1:] = indices[:, 1:] != indices[:, :-1]
        row, col = np.nonzero(fresh)
        for j, raw in enumerate(parts):
            if i != j:
                rows.append(row)
                keys.append((np.int64(3 * i + j) << 35) | (indices[row, col] << 23) | raw[row])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(classes: DataFrame) -> DataFrame:
    """(fp, key) for each distinct fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                row, key = golay_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.array(key)], ["fp", "key"])

    return classes.select("fp").mapInArrow(each, "fp long, key long")


def links(classes: DataFrame, pair_limit: int = PAIR_LIMIT, max_distance: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of the fingerprints at most ``max_distance`` (2) bits apart.

    Nodes are pairs (kind, bits): kind 0 is a fingerprint, 1 a hub.
    """
    if max_distance != 2:
        raise ValueError("keys and hubs are made for two differing bits")
    keyed = _keyed(classes)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = settle(counts, "keys")
    near = keyed.join(counts.where(F.col("n") <= pair_limit), "key")
    x, y = near.select("key", F.col("fp").alias("x")), near.select("key", F.col("fp").alias("y"))
    pairs = x.join(y, "key").where((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_distance))
    pairs = pairs.select(_node(0, "x").alias("a"), _node(0, "y").alias("b"))
    crowded = keyed.join(counts.where(F.col("n") > pair_limit), "key").select("fp").distinct()
    flips = F.array(*[F.lit(f).cast("long") for f in [0, *(1 << k for k in range(63)), -(1 << 63)]])
    hubs = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("hub"))
    shared = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = hubs.join(shared, "hub").select(_node(0, "fp").alias("a"), _node(1, "hub").alias("b"))
    return pairs.unionAll(hubs)


def _node(kind: int, bits: str):
    return F.struct(F.lit(kind).alias("kind"), F.col(bits).alias("bits"))


def grouped(docs: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Per document: doc_id, mark, fingerprint (16 hex digits) and component_id, the smallest doc_id of its component."""
    prints = settle(fingerprints(docs), "fingerprints")
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    found = components(links(classes, pair_limit)).where("node.kind = 0").select(F.col("node.bits").alias("fp"), "component")
    met = found.join(classes, "fp")
    least = met.groupBy("component").agg(F.min("first").alias("least"))
    named = met.join(least, "component").select("fp", "least")
    named = settle(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")), "named")
    met = salted_join(prints, named, "fp", "n", F.col("mark"))
    return met.select("doc_id", "mark", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Per document: doc_id, fingerprint and component_id."""
    return grouped(docs, pair_limit).select("doc_id", "fingerprint", "component_id")


def kept_documents(docs: DataFrame, pair_limit: int = PAIR_LIMIT, groups: DataFrame | None = None) -> DataFrame:
    """One document of each component, with its columns: that with the smallest doc_id. Rows that repeat this id in the
    component count as one. Of documents whose component has no doc_id but null, one of each fingerprint stays.
    ``groups`` are other groups than fingerprints give, with the columns of ``grouped`` (``similar.grouped``).

    Texts that stay and whose doc_id isn't repeated aren't shuffled.
    """
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp "), "fingerprint"))
    groups = grouped(docs, pair_limit) if groups is None else groups
    found = settle(groups.withColumn("_group", group), "components")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    mine = [F.col("doc_id").alias("_of"), F.col("mark").alias("_was"), "_group"]
    gone = found.where(~kept).select(*mine, F.lit(False).alias("_kept"))
    repeated = found.where(kept).groupBy(F.col("doc_id").alias("_id"), F.col("_group").alias("_in")).agg(F.min("mark").alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = found.where(kept).join(repeated.where("_n > 1"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_group") == F.col("_in")))
    states = settle(gone.unionAll(again.select(*mine, (F.col("mark") == F.col("_first")).alias("_kept"))).distinct(), "states")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    flagged = maybe_among(docs.select(whole, F.col("doc_id").alias("_id")), F.col("_id"), states, "_of")
    maybe = flagged.where("_maybe").withColumn("_mark", _mark(F.col("_doc.text")))
    maybe = maybe.join(states, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_mark") == F.col("_was")), "left")
    alone = flagged.where("not _maybe").select("_doc.*")
    single = maybe.where("_group is null").select("_doc.*")
    stay = maybe.where("_kept").groupBy("_id", "_group").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*")
    return alone.unionAll(single).unionAll(stay)
