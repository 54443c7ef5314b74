"""Token ids in files of directly addressable codes.

A file holds the ids of some documents, one after another, and gives any of them without decoding what stands before. The
bits of an id are split into chunks, lowest first. Level 0 has the first chunk of every id; a level's bitmap says which of
its ids go on, and the next level has chunks of just those. Where an id goes on is its rank, the number of ones before it in
the bitmap, which a directory answers with one stored sum and at most 64 bytes of bitmap. So an id takes one read a level:
chunk, bit, rank. Chunk widths are a file's own: those with the fewest bits for its ids, found over their lengths in bits.

    magic, number of ids, of levels; of each level: width, number of chunks, where chunks, bitmap and ranks begin;
    where the directory of documents begins; then these, each at a multiple of 8 bytes

Writing: a task encodes texts word by word, each distinct one once while its dictionary holds it; ids go to a table, packed.
That table is dealt by range of doc_id and sorted there, so files follow one another in that order; a task closes a file
once it has ``FILE_IDS`` ids, and writes it under a temporary name before it is moved into place, so a task that runs again
leaves the same files. The manifest has a row a file, with the number of all ids before it.

Defined results: a null text is empty, and has the end id alone. Ascending ids have null first; rows of one doc_id are in
the order of a hash of their texts, so reruns agree. Texts of any length are encoded whole, and a document is never split
between files. Special strings inside texts are what the tokenizer makes of them. An empty table has no file and no rows.
Other columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..sources.paths import qualified
from .blocks import packed, unpacked
from .mixing import running_total
from .store import settle, shared_folder
from .token_counts import PreTokens
from .warc import _arrow_uri

END = 1
#: Ids from which a file is closed.
FILE_IDS = 1 << 23
#: Characters of texts that are encoded at once, about, and keys of a dictionary.
BATCH_CHARS, DICTIONARY = 1_000_000, 600_000
_MARK = "\x1c"
#: Ids that are read at once, about.
READ_IDS = 1 << 20
#: Most tasks that read files; each reads as many as it takes.
READERS = 20_000
_MAGIC = b"SLDAC\x01\x00\x00"
_BLOCK = 512  # bits for each sum of the rank directory
_LEVEL, _LEVEL_BYTES = "<QQQQQ", 40
MANIFEST = "part int, place int, name string, documents long, ids long"


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on. 255, which
    is in no text, becomes a line end, which is no letter."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = np.arange(256, dtype="<u2")
    out[[b for b in range(256) if b not in visible]] = np.arange(256, 512 - len(visible))
    out[255] = 10
    return out


BYTE_LETTERS = _byte_letters()


def byte_letters(strings: list[str]) -> list[str]:
    """Strings with a letter for each byte, all at once."""
    data = b"\xff".join([s.encode() for s in strings])
    return BYTE_LETTERS[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split("\n")


class _Dictionary:
    """Strings, each with its ids, which stand one after another."""

    def __init__(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def places(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, strings), np.int32, len(strings))

    def new(self) -> list[str]:
        """The strings that have no ids yet, by place."""
        fresh = len(self.index) - (len(self.ends) - 1)
        return list(islice(reversed(self.index), fresh))[::-1]

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new strings, and how many each has."""
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings at ``places``, 0 and where each string's ids end)."""
        starts = self.ends[places]
        sizes = self.ends[places + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of texts, by way of two dictionaries: of what white space parts, and of the pre-tokens in that.

    No pre-token crosses white space, nor does it compose with a mark, so each such word is normalised and split on its own.
    A text with special strings, with characters beyond the quick rules of ``PreTokens``, or with those that only Python
    takes for white space has its pre-tokens as words, marked by one of the latter.
    """

    def __init__(self, path: str):
        self.pre_tokens = PreTokens(path)
        tokenizer = self.pre_tokens.tokenizer
        self.model, self.special = tokenizer.model, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.slow = regex.compile("[^\x00-\x1b\x20-\u04ff]|" + "|".join(map(regex.escape, self.special)))
        self.rare = ["\x1c", "\x1d", "\x1e", "\x1f", *self.special]
        self.split = regex.compile(f"\n|{self.pre_tokens.split.pattern}")
        self._clear()

    def _clear(self) -> None:
        self.words, self.parts = _Dictionary(), _Dictionary()
        self.parts.index["\n"]  # ends a word; it has no ids
        self.parts.add(self.parts.ids, np.zeros(1, np.int64))

    def _of_parts(self, parts: list[str]) -> list[list[int]]:
        special, tokenize = self.special, self.model.tokenize
        return [[special[p]] if p in special else [t.id for t in tokenize(x)] for p, x in zip(parts, byte_letters(parts), strict=True)] if parts else []

    def _slow(self, text: str) -> bool:
        """Whether a text is to be split by ``PreTokens``. Plain finds tell it of ASCII, which is most text."""
        return any(x in text for x in self.rare) if text.isascii() else self.slow.search(text) is not None

    def _parts(self, words: list[str]) -> list[str]:
        """The pre-tokens of each word, and a line end after them."""
        text = "\n".join([*words, ""])
        if _MARK not in text:
            return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return [p for w in words for p in (*([w[1:]] if w[0] == _MARK else self.pre_tokens.of(w)), "\n")]

    def _learn(self) -> None:
        """Ids of the words that are new."""
        words = self.words.new()
        places = self.parts.places(self._parts(words))
        new = self._of_parts(self.parts.new())
        self.parts.add(np.fromiter(chain.from_iterable(new), np.uint32), np.fromiter(map(len, new), np.int64, len(new)))
        ids, ends = self.parts.of(places)
        self.words.add(ids, np.diff(ends[1:][places == 0], prepend=0))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.words.index) > DICTIONARY:
            self._clear()
        places = []
        for t in texts:
            words = [f"{_MARK}{p}" for p in self.pre_tokens.of(t)] if self._slow(t) else t.split()
            places.append(self.words.places(words))
        self._learn()
        ids, ends = self.words.of(np.concatenate(places))
        return ids, np.diff(ends[np.cumsum([0, *map(len, places)])])


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, tie, ids): each document's ids and the end id, packed; ``tie`` orders rows of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    schema = StructType([source.schema["doc_id"], StructField("tie", LongType()), StructField("ids", BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)

        def rows(b: pa.RecordBatch, first: int, texts: list[str]) -> pa.RecordBatch:
            ids, counts = encode(texts)
            cuts, last = np.concatenate([[0], np.cumsum(counts)]), np.array([end], np.uint32)
            data = [packed(np.concatenate([ids[x:y], last])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            part = b.slice(first, len(texts))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], schema.names)

        for b in batches:
            first, texts, chars = 0, [], 0
            for text in b.column(2):
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= BATCH_CHARS:
                    yield rows(b, first, texts)
                    first, texts, chars = first + len(texts), [], 0
            if texts:
                yield rows(b, first, texts)

    return source.mapInArrow(each, schema)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 0 has one."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1)


def best_widths(lengths: np.ndarray) -> list[int]:
    """The chunk widths that take the fewest bits, from how many ids have each length in bits (at 0: none)."""
    most = len(lengths) - 1
    longer = lengths[::-1].cumsum()[::-1]  # ids of at least so many bits
    cost: list[tuple[float, list[int]]] = [(0.0, [])] * (most + 1)
    for done in range(most - 1, -1, -1):
        here = float(longer[done + 1])  # ids that have a chunk from this bit on
        ways = [(here * (w + (1 + 64 / _BLOCK if done + w < most else 0)) + cost[done + w][0], [w, *cost[done + w][1]]) for w in range(1, most - done + 1)]
        cost[done] = min(ways)
    return cost[0][1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, lowest bit first, and 8 bytes to spare."""
    out = []
    for at in range(0, len(values), 1 << 18):  # a multiple of 8, so that pieces end with a byte
        part = values[at : at + (1 << 18)].astype("<u4")
        if width in (8, 16, 32):
            out.append(part.astype(f"<u{width // 8}").tobytes())
        else:
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
            out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out) + bytes(8)


def _padded(data: bytes, to: int) -> bytes:
    return data + bytes(-len(data) % to)


def file_bytes(ids: np.ndarray, documents: pa.RecordBatch) -> bytes:
    """A file of ``ids``; ``documents`` is its directory."""
    widths = best_widths(np.bincount(bit_lengths(ids))) if len(ids) else [1]
    values, sections, levels = ids, [], []
    at = len(_MAGIC) + 24 + _LEVEL_BYTES * len(widths)

    def add(data: bytes) -> int:
        nonlocal at
        sections.append(_padded(data, 8))
        at += len(sections[-1])
        return at - len(sections[-1])

    for k, w in enumerate(widths):
        chunks = add(pack_bits(values & ((1 << w) - 1), w))
        if k + 1 == len(widths):
            levels.append((w, len(values), chunks, 0, 0))
            break
        more = values >> w
        goes_on = more > 0
        bitmap = _padded(np.packbits(goes_on, bitorder="little").tobytes() + bytes(1), _BLOCK // 8)
        ones = np.bitwise_count(np.frombuffer(bitmap, "<u8")).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[np.uint64(0)], np.cumsum(ones)[:-1]]).astype("<u8").tobytes()
        levels.append((w, len(values), chunks, add(bitmap), add(ranks)))
        values = more[goes_on]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as out:
        out.write_batch(documents)
    directory = add(sink.getvalue().to_pybytes())
    head = [_MAGIC, struct.pack("<QQQ", len(ids), len(widths), directory), *(struct.pack(_LEVEL, *x) for x in levels)]
    return b"".join([*head, *sections])


class CodeFile:
    """A file that is open. ``read_at(size, offset)`` gives bytes of it."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        head = read_at(len(_MAGIC) + 24, 0)
        if head[: len(_MAGIC)] != _MAGIC:
            raise ValueError("this is no file of directly addressable codes")
        self.n, count, self.directory = struct.unpack("<QQQ", head[len(_MAGIC) :])
        raw = read_at(_LEVEL_BYTES * count, len(head))
        self.levels = [struct.unpack_from(_LEVEL, raw, _LEVEL_BYTES * k) for k in range(count)]

    def documents(self) -> pa.RecordBatch:
        """(doc_id, end) of each document: the number of ids up to its end."""
        with pa.ipc.open_stream(self.read_at(self.size - self.directory, self.directory)) as stream:
            return stream.read_next_batch()

    def _chunks(self, level: int, a: int, b: int) -> np.ndarray:
        width, _, where, *_ = self.levels[level]
        first = a * width // 8
        data = self.read_at((b * width + 7) // 8 - first + 8, where + first)
        if width in (8, 16, 32):
            return np.frombuffer(data, f"<u{width // 8}", b - a).astype(np.uint32)
        windows = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # 8 bytes from each byte on
        bit = np.arange(a, b) * width - 8 * first
        return ((windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        first = a // 8
        data = np.frombuffer(self.read_at((b + 7) // 8 - first, self.levels[level][3] + first), np.uint8)
        return np.unpackbits(data, bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)

    def rank(self, level: int, a: int) -> int:
        """Ids of a level before ``a`` that go on."""
        block = a // _BLOCK
        before = int.from_bytes(self.read_at(8, self.levels[level][4] + 8 * block), "little")
        return before + (int(self._bits(level, block * _BLOCK, a).sum()) if a % _BLOCK else 0)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from ``a`` up to ``b``; of each level, only their own chunks are read."""
        if not 0 <= a <= b <= self.n:
            raise IndexError(f"ids from {a} to {b} of {self.n}")
        out, place, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for k, level in enumerate(self.levels):
            if a == b:
                break
            out[place] |= self._chunks(k, a, b) << np.uint32(shift)
            if k + 1 < len(self.levels):
                goes_on = self._bits(k, a, b)
                a = self.rank(k, a)
                place, shift = place[goes_on], shift + level[0]
                b = a + len(place)
        return out

    def at(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])


def _files(rows: Iterable[tuple[object, bytes]], kind: pa.DataType) -> Iterator[tuple[bytes, int, int]]:
    """(content, documents, ids) of the files that some (doc_id, packed ids) make."""
    names, ids, n = [], [], 0
    for doc_id, data in rows:
        names.append(doc_id)
        ids.append(unpacked(data).astype(np.uint32))
        n += len(ids[-1])
        if n >= FILE_IDS:
            yield _file(names, ids, kind), len(names), n
            names, ids, n = [], [], 0
    if names:
        yield _file(names, ids, kind), len(names), n


def _file(names: list, ids: list[np.ndarray], kind: pa.DataType) -> bytes:
    ends = np.cumsum([len(x) for x in ids])
    return file_bytes(np.concatenate(ids), pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(ends, pa.int64())], ["doc_id", "end"]))


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> DataFrame:
    """Write the ids of documents to files below ``folder``; returns the manifest, which is written there too.

    It has a row a file: part and place (files are in that order), name, documents, ids, and start, all ids before it.
    """
    spark = docs.sparkSession
    into = _arrow_uri(qualified(spark, f"{folder}/files"))
    sorted_ = settle(encoded(docs, path, end), "ids").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(into)
        store.create_dir(base)
        part, kind = TaskContext.get().partitionId(), pa.int64()

        def rows() -> Iterator[tuple[object, bytes]]:
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield from zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True)

        out = []
        source = rows()
        first = next(source, None)
        if first is not None:
            for place, (content, documents, ids) in enumerate(_files(_chained(first, source), kind)):
                name = f"part-{part:06}-{place:06}.ids"
                part_name = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part_name, compression=None) as sink:
                    sink.write(content)
                store.move(part_name, f"{base}/{name}")
                out.append((part, place, name, documents, ids))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "place", "name", "documents", "ids"])

    files = settle(sorted_.select("doc_id", "ids").mapInArrow(each, MANIFEST), "files")
    # a row a file; their sums are made by range, in no one task
    placed = running_total(files, [F.col("part"), F.col("place")], {"start": "ids"})
    placed.select("part", "place", "name", "documents", "ids", F.col("start").cast("long").alias("start")).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, start long").parquet(f"{folder}/manifest")


def _opened(store: pafs.FileSystem, base: str, name: str) -> tuple[pa.NativeFile, CodeFile]:
    file = store.open_input_file(f"{base}/{name}")
    return file, CodeFile(file.read_at, file.size())


def read_documents(spark: SparkSession, folder: str, kind: StructField) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32, from the files. ``kind`` is the field doc_id."""
    origin, files = _arrow_uri(qualified(spark, f"{folder}/files")), manifest(spark, folder)
    schema = StructType([kind, *[StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(origin)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file, codes = _opened(store, base, name)
                with file:
                    held = codes.documents()
                    ends = np.concatenate([[0], held.column(1).to_numpy()])
                    crcs = np.empty(len(held), np.int64)
                    first = 0
                    while first < len(held):  # whole documents, about as many ids as are read at once
                        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + READ_IDS, "right")) - 1)
                        ids = codes.ids(int(ends[first]), int(ends[stop])).astype("<u4")
                        for k in range(first, stop):
                            crcs[k] = zlib.crc32(ids[ends[k] - ends[first] : ends[k + 1] - ends[first]])
                        first = stop
                    yield pa.RecordBatch.from_arrays([held.column(0), pa.array(ends[:-1] + start), pa.array(np.diff(ends)), pa.array(crcs)], schema.names)

    # files are few and their rows short: they are dealt to tasks by number, which nothing joins again
    tasks = min(READERS, max(1, files.count()))
    return files.select("name", "start").repartition(tasks).mapInArrow(each, schema)


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """(position, id) of each distinct position among all ids, of which only what is asked for is read; the id of a position
    that there isn't is null, and null positions are left out."""
    origin = _arrow_uri(qualified(spark, f"{folder}/files"))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct()
    step = F.lit(FILE_IDS)
    bins = F.sequence((F.col("start") / step).cast("long"), ((F.col("start") + F.col("ids") - 1) / step).cast("long"))
    files = manifest(spark, folder).where("ids > 0").select("name", "start", "ids", F.explode(bins).alias("_bin"))
    met = asked.withColumn("_bin", F.floor(F.col("position") / step)).join(files, "_bin").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("ids")))
    near = F.floor(F.col("position") / 65536)
    dealt = met.select("name", (F.col("position") - F.col("start")).alias("local"), "position", near.alias("_near")).repartition("name", "_near").sortWithinPartitions("name", "local")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(origin)
        name, file, codes = None, None, None
        for b in batches:
            ids = []
            for n, local in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != name:
                    if file is not None:
                        file.close()
                    name, (file, codes) = n, _opened(store, base, n)
                ids.append(codes.at(local))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ids, pa.int64())], ["position", "id"])
        if file is not None:
            file.close()

    found = dealt.select("name", "local", "position").mapInArrow(each, "position long, id long")
    return asked.join(found, "position", "left")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from files that are written and read back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "codes")
    write(docs, path, folder)
    return read_documents(spark, folder, docs.schema["doc_id"])
