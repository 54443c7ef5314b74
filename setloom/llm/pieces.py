"""SentencePiece encoding and decoding by a relational lattice.

A text, with a space as ``▁`` and one put in front, is cut into units that no piece of the vocabulary crosses: a run of
letters, or of other signs, that occur in pieces of several characters, with the ``▁`` before it; any other character is a
unit by itself. Texts become numbers in dictionaries of their blocks (module ``blocks``). All distinct units are segmented
once: every substring of bounded length is exploded and equi-joined to the table of pieces; the edges that exist are
grouped by unit, and a fold over them with Spark's higher-order ``aggregate`` finds the segmentation. The ids are dealt to
the blocks that hold the unit, and documents are put together there.

A model of type BPE merges neighbours by score, which is not the segmentation of highest total score, so for it the fold
applies the best merge that is possible, again and again, to a bit mask of boundaries. For a unigram model the fold is
Viterbi's. Characters without a piece become their bytes' pieces.

A unit of more than ``UNIT_CHARS`` characters does not fit a mask. It stays with its block, where the same lattice and
fold are made by a function of the task.

Defined results: a null or empty text has no ids. ``▁`` itself in a text counts as a space, and is decoded as one. Rows
that repeat a doc_id are encoded each on its own; texts of any length are encoded whole. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from . import blocks

SPACE = "▁"
#: The most characters of a unit whose boundaries fit a mask.
UNIT_CHARS = 62
#: Characters of a text that are split at once, about.
STRETCH = 1 << 16
#: Documents that are decoded at once.
AT_ONCE = 256
_NORMAL, _UNKNOWN, _CONTROL, _BYTE, _BPE, _UNIGRAM = 1, 2, 3, 6, 2, 1


@dataclass(frozen=True)
class Model:
    """What is needed of a model file."""

    bpe: bool
    pieces: list[tuple[str, int, float]]
    first_byte: int
    longest: int

    @classmethod
    def load(cls, path: str) -> Model:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models without normalisation, with a space put in front and bytes for unknown characters, are supported")
        if kind not in (_BPE, _UNIGRAM) or any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in proto.pieces):
            raise ValueError("only models of type BPE or unigram without user-defined or unused pieces are supported")
        pieces = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == _NORMAL]
        first = next(i for i, p in enumerate(proto.pieces) if p.type == _BYTE)
        out = cls(kind == _BPE, pieces, first, max(len(p) for p, _, _ in pieces))
        unit = re.compile(out.unit())
        if any(unit.findall(p) != [p] for p, _, _ in pieces):
            raise ValueError("a piece crosses units")
        return out

    def unit(self) -> str:
        """The pattern of units."""
        joining = sorted({c for p, _, _ in self.pieces if len(p) > 1 for c in p} - {SPACE})
        letters, others = ("".join(re.escape(c) for c in joining if c.isalpha() == kind) for kind in (True, False))
        return "|".join([f"{SPACE}*[{x}]+" for x in (letters, others) if x] + [f"{SPACE}+", "(?s:.)"])

    def ranks(self) -> dict[str, int]:
        """Pieces by score, the best 0; pieces of one score have one rank."""
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return {p: order[s] for p, _, s in self.pieces}

    def late(self) -> set[str]:
        """Pieces that may be put together of a part that ranks after them."""
        ranks, out = self.ranks(), set()
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                parts = [x for x in (piece[:k], piece[k:]) if len(x) > 1]
                if all(x in ranks for x in parts) and any(ranks[x] >= rank for x in parts):
                    out.add(piece)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, rank, late): as many rows as the vocabulary has, whatever the input."""
        ranks, late = self.ranks(), self.late()
        return spark.createDataFrame([(p, i, s, ranks[p], p in late) for p, i, s in self.pieces], "piece string, id int, score double, rank long, late boolean")


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def splitter(pattern: str) -> blocks.Splitter:
    """A function from a text to its units. A long text is split a stretch at a time: a ``▁`` after another sign begins a unit."""
    units, boundary = re.compile(pattern).findall, re.compile(f"[^{SPACE}]{SPACE}").search

    def stretches(text: str) -> Iterator[list[str]]:
        at, end = 0, len(text)
        while at < end:
            found = boundary(text, at + STRETCH)
            to = found.start() + 1 if found else end
            yield units(text, at, to)
            at = to

    return lambda text: chain.from_iterable(stretches(escaped(text)))


def spans(units: DataFrame, model: Model) -> DataFrame:
    """The lattice's edges: ``units`` with size, start, length, and of the piece id, score and rank.

    An edge is a substring that is a piece, or one character that isn't (id null).
    """
    u = units.withColumn("size", F.char_length("unit"))
    u = u.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    u = u.withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("size") - F.col("start")))))
    u = u.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("length")))
    return u.join(F.broadcast(model.table(units.sparkSession)), "piece", "left").where("id is not null or length = 1").drop("piece")


def _bytes(unit: Column, start: Column, first_byte: int) -> Column:
    """The ids of the bytes of one character."""
    raw = F.substring(unit, start + 1, F.lit(1)).cast("binary")
    return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda j: F.conv(F.hex(F.substring(raw, j, F.lit(1))), 16, 10).cast("int") + first_byte)


# an edge as a long: rank, start, length, whether it is late, and id, from the highest bits on
_RANK, _START, _LENGTH, _LATE = 40, 34, 28, 27


def _left(n: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", n.cast("long"), F.lit(by) if isinstance(by, int) else by)


def _right(n: Column, by: int) -> Column:
    return F.call_function("shiftrightunsigned", n, F.lit(by))


def _ones(n: Column) -> Column:
    """The lowest ``n`` bits, of which there are 1 to 63; no sum or difference can overflow."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(64) - n)


def _field(edge: Column, low: int, high: int) -> Column:
    return _right(edge, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")).cast("int")


def merged(units: DataFrame, model: Model) -> DataFrame:
    """``units`` with ids, by merging: the best edge whose ends are boundaries with just one boundary between is applied.

    One fold over a unit's edges by rank, then from the left, does it, as parts of a piece nearly always rank before it. A
    merge that makes an edge possible which the fold has passed already is noticed; for such a unit the best edge is
    searched again after every merge.
    """
    long = F.col("length") > 1
    late = F.when(F.col("late"), F.lit(1 << _LATE)).otherwise(F.lit(0)).cast("long")
    place = _left(F.col("start"), _START).bitwiseOR(_left(F.col("length"), _LENGTH))
    merge = place.bitwiseOR(_left(F.col("rank"), _RANK)).bitwiseOR(late).bitwiseOR(F.col("id").cast("long"))
    char = place.bitwiseOR(F.coalesce(F.col("id") + 1, F.lit(0)).cast("long"))  # 0: no piece
    rows = spans(units, model).groupBy(*units.columns, "size").agg(F.sort_array(F.collect_list(F.when(long, merge))).alias("_merges"), F.collect_list(F.when(~long, char)).alias("_chars"))
    # the boundaries that an edge covers, its ends included
    covered = lambda e: _left(_ones(_field(e, _LENGTH, _START) + 1), _field(e, _START, _RANK))
    rows = rows.withColumn("_merges", F.transform("_merges", lambda e: F.struct(e.alias("edge"), covered(e).alias("all"))))
    rows = rows.withColumn("_late", F.filter("_merges", lambda e: e["edge"].bitwiseAND(F.lit(1 << _LATE).cast("long")) != 0))

    def spanned(mask: Column, e: Column, n: int) -> Column:
        """Whether just ``n`` boundaries stand in an edge, its first and its last among them."""
        here = mask.bitwiseAND(e["all"])
        return (F.bit_count(here) == n) & (here > _right(e["all"], 1)) & (here.bitwiseAND(F.bitwise_not(_left(e["all"], 1))) != 0)

    def without(mask: Column, e: Column) -> Column:
        inside = e["all"].bitwiseAND(_left(e["all"], 1)).bitwiseAND(_right(e["all"], 1))
        return mask.bitwiseAND(F.bitwise_not(inside))

    flag = F.lit(-(1 << 63)).cast("long")  # no boundary has this bit

    def in_order(mask: Column, e: Column) -> Column:
        new = without(mask, e)
        passed = F.exists("_late", lambda f: (f["edge"] < e["edge"]) & spanned(new, f, 3))
        return F.when(spanned(mask, e, 3), F.when(passed, new.bitwiseOR(flag)).otherwise(new)).otherwise(mask)

    def best_first(mask: Column, _: Column) -> Column:
        best = F.filter("_merges", lambda e: spanned(mask, e, 3))
        return F.coalesce(F.get(F.transform(F.slice(best, 1, 1), lambda e: without(mask, e)), 0), mask)

    # columns that lambdas read are named twice below: what is named once the planner would put into the lambda, and work
    # out for every element
    rows = rows.withColumn("_all", _ones(F.col("size") + 1))
    rows = rows.withColumn("_mask", F.when(F.size("_late") >= 0, F.aggregate("_merges", F.col("_all"), in_order)))
    again = F.aggregate(F.sequence(F.lit(1), F.col("size")), F.col("_all"), best_first)
    rows = rows.withColumn("_mask", F.when(F.col("_mask") < 0, again).otherwise(F.col("_mask")))
    whole = F.transform(F.filter("_merges", lambda e: spanned(F.col("_mask"), e, 2)), lambda e: F.struct(_field(e["edge"], _START, _RANK).alias("start"), _field(e["edge"], 0, _LATE).alias("id")))
    alone = F.filter("_chars", lambda c: F.call_function("shiftright", F.col("_mask"), _field(c, _START, _RANK)).bitwiseAND(F.lit(3).cast("long")) == 3)
    alone = F.transform(alone, lambda c: F.struct(_field(c, _START, _RANK).alias("start"), (_field(c, 0, _LATE) - 1).alias("id")))
    ids = F.transform(F.sort_array(F.concat(whole, alone)), lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(_bytes(F.col("unit"), e["start"], model.first_byte)))
    return rows.select(*units.columns, F.flatten(ids).alias("ids"))


def _unknown(model: Model) -> float:
    """The score of a character without a piece."""
    return float(min(s for _, _, s in model.pieces)) - 10.0


def viterbi(units: DataFrame, model: Model) -> DataFrame:
    """``units`` with ids of the highest total score; of equal ones, those whose last pieces are longest."""
    end = F.col("start") + F.col("length")
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(_bytes(F.col("unit"), F.col("start"), model.first_byte))
    edge = F.struct("start", end.alias("end"), F.coalesce("score", F.lit(_unknown(model))).alias("score"), ids.alias("ids"))
    rows = spans(units, model).groupBy(*units.columns, "size").agg(F.collect_list(edge).alias("_edges"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("longer"), F.array().cast("array<int>").alias("ids")))

    def step(best: Column, end: Column) -> Column:
        arriving = F.filter("_edges", lambda e: e["end"] == end)
        ways = F.transform(
            arriving, lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (end - e["start"]).alias("longer"), F.concat(F.get(best, e["start"])["ids"], e["ids"]).alias("ids"))
        )
        return F.concat(best, F.array(F.array_max(ways)))

    return rows.select(*units.columns, F.aggregate(F.sequence(F.lit(1), F.col("size")), start, step, lambda b: F.get(b, F.size(b) - 1)["ids"]).alias("ids"))


class LongUnits:
    """The same lattice and fold for one unit of any length, in time proportional to its edges."""

    def __init__(self, model: Model):
        self.model, self.ranks, self.ids = model, model.ranks(), {p: i for p, i, _ in model.pieces}
        self.scores = {p: s for p, _, s in model.pieces}

    def of(self, unit: str) -> list[int]:
        cuts = self._merged(unit) if self.model.bpe else self._viterbi(unit)
        out: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = self.ids.get(unit[a:b])
            out += [i] if i is not None else [self.model.first_byte + x for x in unit[a:b].encode("utf-8", "surrogatepass")]
        return out

    def _merged(self, unit: str) -> list[int]:
        n = len(unit)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # neighbouring boundaries
        ways: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            """The merge of the symbols that meet at the boundary after ``a``."""
            middle = after[a]
            if middle < n and (rank := self.ranks.get(unit[a : after[middle]])) is not None:
                heapq.heappush(ways, (rank, a, middle, after[middle]))

        for a in range(n - 1):
            offer(a)
        while ways:
            _, a, middle, b = heapq.heappop(ways)
            if after[a] != middle or after[middle] != b:
                continue  # one of the symbols is gone
            after[a], before[b], after[middle] = b, a, -1
            offer(a)
            if a:
                offer(before[a])
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        return cuts

    def _viterbi(self, unit: str) -> list[int]:
        best, back, unknown = [0.0], [0], _unknown(self.model)
        for end in range(1, len(unit) + 1):
            ways = []
            for start in range(max(0, end - self.model.longest), end):
                score = self.scores.get(unit[start:end], unknown if end - start == 1 else None)
                if score is not None:
                    ways.append((best[start] + score, end - start))
            score, length = max(ways)
            best.append(score)
            back.append(end - length)
        cuts = [len(unit)]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return cuts[::-1]


def _streams(places: list[np.ndarray]) -> list[np.ndarray]:
    return [np.array([len(p) for p in places]), np.concatenate(places)]


def encode(docs: DataFrame, path: str, unit_chars: int = UNIT_CHARS, with_decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` in place of ``text``. ``path`` is a SentencePiece model. A column ``ids`` is replaced.

    ``with_decoded`` adds what the ids decode to as ``decoded``.
    """
    model = Model.load(path)
    pattern = model.unit()
    carried = [c for c in docs.columns if c not in ("text", "ids") and not (with_decoded and c == "decoded")]
    rows = blocks.dealt(docs, carried, lambda: splitter(pattern), _streams, unit_chars)
    units = blocks.distinct_units(rows)
    values = blocks.for_blocks(rows, merged(units, model) if model.bpe else viterbi(units, model), "ids")
    schema = StructType([docs.schema[c] for c in carried] + [StructField("ids", ArrayType(IntegerType()))] + [StructField("decoded", StringType())] * with_decoded)

    def finish(found: list[np.ndarray], long: list[str], long_places: np.ndarray) -> blocks.Finish:
        places, counts, ids = found or [np.empty(0, np.int64)] * 3
        fold = LongUnits(model)
        more = [fold.of(u) for u in long]
        counts = np.concatenate([counts, [len(x) for x in more]]).astype(np.int32)
        ids = np.concatenate([ids, [i for x in more for i in x]]).astype(np.int32)
        at = np.empty(len(counts), np.int64)
        at[np.concatenate([places, long_places])] = np.arange(len(counts))
        starts = np.cumsum(counts) - counts
        starts, counts = starts[at], counts[at]
        decoder = Decoder(model) if with_decoded else None

        def of(columns: list[pa.Array], streams: list[np.ndarray]) -> list[pa.Array]:
            sizes, units = streams
            flat, ends = _gather(ids, starts[units], counts[units])
            lists = pa.LargeListArray.from_arrays(pa.array(ends[np.cumsum([0, *sizes])], pa.int64()), pa.array(flat, pa.int32()))
            lists = lists.cast(pa.list_(pa.int32()))
            return [*columns[: len(carried)], lists, *([decoder.texts(lists)] if decoder else [])]

        return of

    return blocks.by_block(rows, values, finish, schema)


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one after another, and where each begins, and the last ends."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends


def _texts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of UTF-8. Bytes that are none become the replacement character."""
    out = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        return pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    return out.cast(pa.string())


class Decoder:
    """The bytes of each piece."""

    def __init__(self, model: Model):
        content = {i: p.replace(SPACE, " ").encode() for p, i, _ in model.pieces} | {model.first_byte + k: bytes([k]) for k in range(256)}
        by_id = [content.get(i, b"") for i in range(max(content) + 1)]
        self.lengths = np.array([len(c) for c in by_id])
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(by_id), np.uint8)

    def texts(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("ids that are no piece of text")
        data, ends = _gather(self.flat, self.starts[ids], self.lengths[ids])
        ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])]
        some = ends[:-1] < ends[1:]
        spaced = np.zeros(len(ends) - 1, np.int64)
        spaced[some] = data[ends[:-1][some]] == 32
        data = np.delete(data, ends[:-1][spaced == 1])
        return _texts(data, ends - np.concatenate([[0], np.cumsum(spaced)]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (…, ids) with ``text``: pieces' bytes, put together; the space that was put in front is taken away.

    Ids that are no piece of text, as of control pieces, fail. A null in place of ids is decoded as no ids. A column
    ``text`` is replaced.
    """
    model = Model.load(path)
    encoded = encoded.drop("text")
    position = encoded.columns.index("ids")
    schema = StructType([*encoded.schema.fields, StructField("text", StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.texts(part.column(position))], schema.names)

    return encoded.mapInArrow(each, schema)


def encoded_and_checked(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids, and text_sha256 of the text that the ids decode to."""
    back = encode(docs.select("doc_id", "text"), path, with_decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("text_sha256"))
