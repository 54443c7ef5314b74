"""Quality rules: base counts, and how far a document's make-up diverges from its language's.

Base rule: a document fails that has fewer than 50 words, or of whose words more than half stand in three-word windows
that occur twice or more in it.

Divergence: two histograms of a document, of character classes and of common words, are compared with those of its
language by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). A language's reference is the mean
histogram of all its documents that pass the base rule and the length guards; every language with enough of them has one.
A null language, and one with few such documents, has no sound reference: its documents aren't judged by common words,
as those differ from language to language, and by character classes they are compared with the mean over all documents.
A document that is too short for a histogram isn't judged by it.

Languages with at least a 256th of the documents (256 at most) get their reference by broadcast, the others by a shuffle in
which no key is hot.

Everything is DataFrame expressions. Repeated windows are found inside the row: windows are hashed, hash and position
are packed into one long and sorted, and neighbours with one hash are compared word by word.

Defined results: a null text is empty and fails. Texts of any length are read whole. Rows that repeat a doc_id are judged
each by its own text. Empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import maybe_among
from .store import settle
from .text import SPACE, or_empty, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
#: Frequent words of English, French, German and Spanish; fixed values.
COMMON_WORDS = (
    "the of and to in is that for"
    " le la les et un une du que"
    " der die das und den ist ein von"
    " el los las y en por una con"
).split()
#: Classes that are counted, beside white space and the rest (mostly lower-case letters).
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", SYMBOLS)
#: Documents of fewer characters or words aren't judged by the histogram of that kind, nor do they shape a reference.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 100
#: Largest distances that a kept document may have.
MAX_CLASS_DISTANCE = 0.25
MAX_COMMON_DISTANCE = 0.3
#: A language is hot from this share of all documents; so at most as many are. And documents that a reference needs.
HOT_SHARE = 256
MIN_DOCUMENTS = 20


def with_repeat_words(t: DataFrame, words_column: str, size_column: str) -> DataFrame:
    """``t`` with ``n_repeat_words``: words that stand in a three-word window found twice or more.

    What lambdas read is a column of its own: an expression inside a lambda is worked out once an element.
    """
    w = F.col(words_column)
    t = t.withColumn("_bits", F.length(F.bin(F.col(size_column))))
    windows = F.transform(
        F.sequence(F.lit(0), F.col(size_column) - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")),
    )
    t = t.withColumn("_packed", F.when(F.col(size_column) < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(windows)))
    t = t.withColumn("_mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    packed = F.col("_packed")

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.col("_mask")).cast("int")

    # neighbours of one hash, as pairs of positions in which the left one comes first
    pairs = F.transform(packed, lambda x, k: F.struct(x.alias("x"), F.get(packed, k + 1).alias("y")))
    alike = F.filter(pairs, lambda p: F.call_function("shiftrightunsigned", p["x"].bitwiseXOR(p["y"]), F.col("_bits")) == 0)
    alike = F.transform(alike, lambda p: F.struct(position(p["x"]).alias("i"), position(p["y"]).alias("j")))
    t = t.withColumn("_alike", alike)

    def word_by_word(p: Column) -> Column:
        i, j = p["i"], p["j"]
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter("_alike", word_by_word), lambda p: F.array(p["i"], p["j"])))))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["total"] + p + 3 - F.greatest(p, a["end"])).alias("total"), (p + 3).alias("end")),
        lambda a: a["total"],
    )
    return t.withColumn("n_repeat_words", covered.cast("long")).drop("_bits", "_packed", "_mask", "_alike")


_OWN = ("_text", "_words", "_n", "_lines", "_chars", "_spaces", "_classes")


def features(docs: DataFrame, *carried: Column) -> DataFrame:
    """Per document: doc_id, lang, the carried columns, the base counts and the two histograms, as counts."""
    t = docs.select("doc_id", "lang", *carried, or_empty(F.col("text")).alias("_text"))
    t = t.withColumn("_words", words(F.col("_text")))
    t = t.withColumn("_n", F.size("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    t = t.withColumn("_lines", lines)
    t = t.withColumn("_chars", F.char_length("_text")).withColumn("_spaces", F.regexp_count("_text", F.lit(SPACE)))
    t = t.withColumn("_classes", F.array(*[F.regexp_count("_text", F.lit(c)) for c in CLASSES]))
    counted = F.array(*[F.col("_n") - F.size(F.array_remove("_words", w)) for w in COMMON_WORDS])
    known = ["doc_id", "lang", *[c for c in t.columns[2:] if c not in _OWN]]
    t = with_repeat_words(t, "_words", "_n").select(
        *known,
        F.col("_n").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_spaces")).cast("long").alias("word_chars"),
        F.element_at("_classes", len(CLASSES)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "_chars",
        F.concat(F.array("_spaces"), F.col("_classes")).alias("_class_counts"),
        counted.alias("_word_counts"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return t.withColumn("base_failed", failed)


def _with_rest(counts: str, total: str) -> Column:
    """A histogram: the shares of the counts, then of what is left of the total."""
    all_ = F.greatest(F.col(total), F.lit(1)).cast("double")
    rest = F.aggregate(F.col(counts), F.col(total).cast("long"), lambda a, x: a - x)
    return F.concat(F.transform(counts, lambda x: x / all_), F.array(F.greatest(rest, F.lit(0)) / all_))


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms of one length."""

    def share(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (share(x, (x + y) / 2) + share(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(languages, all): each language's rows and mean histograms (null without a sound reference), and one row for all documents."""
    sound = ~F.col("base_failed") & (F.col("_chars") >= MIN_CHARS_FOR_CLASSES) & (F.col("n_words") >= MIN_WORDS_FOR_COMMON)
    sums = [F.count(F.lit(1)).alias("_rows"), F.count_if(sound).alias("_docs")]
    for name, n in (("_class", len(CLASSES) + 2), ("_word", len(COMMON_WORDS) + 1)):
        sums.append(F.array(*[F.avg(F.when(sound, F.element_at(f"{name}_hist", k + 1))) for k in range(n)]).alias(f"{name}_ref"))
    by_lang = hist.where("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(*sums)
    enough = F.col("_docs") >= MIN_DOCUMENTS
    by_lang = by_lang.select("_lang", "_rows", *[F.when(enough, F.col(c)).alias(c) for c in ("_class_ref", "_word_ref")])
    pooled = hist.agg(*sums).where("_docs > 0").select(F.col("_class_ref").alias("_class_all"))
    return settle(by_lang, "languages"), settle(pooled, "pooled")


def with_references(hist: DataFrame, langs: DataFrame) -> DataFrame:
    """``hist`` with the histograms of its language, null where it has none."""
    total = langs.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    refs = ["_class_ref", "_word_ref"]
    hot = langs.where(F.col("_rows") * HOT_SHARE > total).select("_lang", F.struct(*refs).alias("_hot"))
    seen = hist.join(F.broadcast(hot), F.col("lang") == F.col("_lang"), "left").drop("_lang")
    easy = seen.where("_hot is not null or lang is null").select(*hist.columns, *[F.col(f"_hot.{c}").alias(c) for c in refs])
    hard = seen.where("_hot is null and lang is not null").select(*hist.columns)
    return easy.unionAll(hard.join(langs.select("_lang", *refs), F.col("lang") == F.col("_lang")).select(*hist.columns, *refs))


def judge(docs: DataFrame, *carried: Column) -> DataFrame:
    """Per document: doc_id, carried columns, base counts, base_failed, both distances (that of common words is null without a reference) and ``kept``."""
    hist = features(docs, *carried)
    hist = hist.withColumn("_class_hist", _with_rest("_class_counts", "_chars")).withColumn("_word_hist", _with_rest("_word_counts", "n_words"))
    hist = settle(hist.drop("_class_counts", "_word_counts"), "histograms")
    langs, pooled = references(hist)
    joined = with_references(hist, langs).join(F.broadcast(pooled), how="left")
    far = joined.withColumn("class_distance", distance(F.col("_class_hist"), F.coalesce("_class_ref", "_class_all")))
    far = far.withColumn("common_distance", F.when(F.col("_word_ref").isNotNull(), distance(F.col("_word_hist"), F.col("_word_ref"))))
    odd_classes = (F.col("_chars") >= MIN_CHARS_FOR_CLASSES) & (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_WORDS_FOR_COMMON) & (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE)
    far = far.withColumn("kept", ~F.col("base_failed") & ~odd_classes & ~odd_words)
    return far.drop("_chars", "_class_hist", "_word_hist", "_class_ref", "_word_ref", "_class_all")


def _mark(text: Column) -> Column:
    return F.md5(or_empty(text))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Texts that can't be rejected ones aren't shuffled."""
    decided = judge(docs.select("doc_id", "lang", "text"), _mark(F.col("text")).alias("_mark"))
    gone = settle(decided.where("not kept").select(F.col("doc_id").alias("_of"), F.col("lang").alias("_in"), F.col("_mark").alias("_was")).distinct(), "rejected")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    flagged = maybe_among(docs.select(whole, F.col("doc_id").alias("_id")), F.col("_id"), gone, "_of")
    maybe = flagged.where("_maybe").withColumn("_mark", _mark(F.col("_doc.text")))
    rest = maybe.join(gone, F.col("_id").eqNullSafe(F.col("_of")) & F.col("_doc.lang").eqNullSafe(F.col("_in")) & (F.col("_mark") == F.col("_was")), "left_anti")
    return flagged.where("not _maybe").select("_doc.*").unionAll(rest.select("_doc.*"))
