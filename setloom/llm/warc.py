"""WARC archives: writing pages, and normalising archives that are one gzip stream.

``write_archives`` writes a record for each page with Spark's text writer; gzip makes of each file one stream, in which
no record can be reached but by inflating all before it. ``normalise`` inflates such a stream once, piece by piece, and
rewrites each record as a gzip member of its own; the offsets of all members are kept in a sidecar index, a Parquet
table. ``read_records`` reaches records by that index. Archives are independent, so each is one task's work; a task
that runs again writes the same bytes under a temporary name and then moves them into place.

Pages whose payloads of at least 100 bytes are equal are written once, as the response of the smallest page_id; others
revisit it, and have no body. Only payloads whose digest may occur twice (by a filter of fixed size) are shuffled.

Defined results: a null page is an empty payload. Rows that repeat a page_id are records of their own; those with the
smallest page_id of equal payloads are all responses. A null page_id is kept; it is never referred to. Line ends in a URL are
percent-encoded; a null URL leaves its header out. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import qualified
from .joins import maybe_among, salted_join
from .store import settle, shared_folder

MIN_REVISIT_BYTES = 100
#: Records of one archive at most.
ARCHIVE_RECORDS = 50_000
#: Records whose offsets a task passes on at once.
INDEX_ROWS = 10_000
#: Bytes of payloads, and records, that a task passes on at once.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 1000
#: Bytes of a stream that are inflated at once.
CHUNK = 1 << 18
_END = b"\r\n\r\n"
INDEX = "archive string, offset long, length long, page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to); refers_to is null for a response."""
    text = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha2(text, 256).alias("payload_digest"))
    large = p.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = settle(groups, "payloads")
    flagged = maybe_among(p, F.col("payload_digest"), groups, "payload_digest")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    alone = flagged.where("not _maybe").select(*columns, F.lit(None).cast(p.schema["page_id"].dataType).alias("refers_to"))
    met = salted_join(flagged.where("_maybe").drop("_maybe"), groups, "payload_digest", "_n", F.col("page_id"), "left", p.count())
    return alone.unionAll(met.select(*columns, F.when(F.col("_first") < F.col("page_id"), F.col("_first")).alias("refers_to")))


def record_text() -> Column:
    """A page's record, without the two line ends that close it."""
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(line + line))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(line + line),
        block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives below ``path``, each one gzip stream of records."""
    lines = with_revisits(pages).select(record_text().alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", _END.decode()).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece. ``read`` gives so many more bytes, none at the end."""
    stream = zlib.decompressobj(31)
    while rest := read(CHUNK):
        while rest:
            if stream.eof:
                stream = zlib.decompressobj(31)
            out = stream.decompress(rest, 4 * CHUNK)
            if out:
                yield out
            rest = stream.unconsumed_tail or stream.unused_data
    if not stream.eof:
        raise ValueError("a gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, whole record, block) of each record in a stream of bytes."""
    held = bytearray()

    def until(size: int) -> None:
        while len(held) < size:
            more = next(pieces, None)
            if more is None:
                raise ValueError("an archive ends inside a record")
            held.extend(more)

    while True:
        if not held:
            more = next(pieces, None)
            if more is None:
                return
            held.extend(more)
        seen = 0
        while (end := held.find(_END, max(0, seen - 3))) < 0:
            seen = len(held)
            until(seen + 1)
        first, *lines = held[:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {first[:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + len(_END)
        stop = start + int(fields["content-length"])
        until(stop + len(_END))
        if held[stop : stop + len(_END)] != _END:
            raise ValueError("a record does not end where its length says")
        yield fields, bytes(held[: stop + len(_END)]), bytes(held[start:stop])
        del held[: stop + len(_END)]


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:page:") : -1] or None if urn else None


def _arrow_uri(path: str) -> str:
    """A path with a scheme as Arrow writes it: Hadoop leaves out the empty authority, and doesn't escape."""
    return quote(re.sub("^([a-z0-9+.-]+):/(?!/)", r"\1:///", path), safe="/:")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives below ``source`` to ``target``, a record a member; returns the sidecar index, settled.

    Tasks get the archives' paths, and read and write them through Arrow's file systems, a piece at a time.
    """
    files = spark.read.format("binaryFile").load(source).select("path")
    into = _arrow_uri(qualified(spark, target))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(into)
        store.create_dir(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                part, at, rows = f"{folder}/.{name}.{uuid.uuid4().hex}", 0, []
                origin, place = pafs.FileSystem.from_uri(_arrow_uri(path))
                # the archive is inflated here, once
                with origin.open_input_stream(place, compression=None) as archive, store.open_output_stream(part, compression=None) as out:
                    for fields, whole, _ in records(inflated(archive.read)):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        size = whole.find(b"Content-Length: ", whole.find(_END)) + 16
                        body = int(whole[size : whole.find(b"\r\n", size)])
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((name, at, len(member), _page(fields["warc-record-id"]), fields["warc-type"], body, digest, _page(fields.get("warc-refers-to"))))
                        at += len(member)
                        if len(rows) == INDEX_ROWS:
                            yield _index_batch(rows)
                            rows = []
                store.move(part, f"{folder}/{name}")
                yield _index_batch(rows)

    return settle(files.mapInArrow(each, INDEX), "offsets")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def read_records(index: DataFrame, folder_uri: str, payloads: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Read each record of an index by its offset: page_id, record_type, refers_to, payload (null for a revisit; left out
    without ``payloads``), and its digest and size: of what was read for a response, as the record says for a revisit.

    A task holds a record, and payloads of ``batch_bytes`` before it.
    """
    origin = _arrow_uri(qualified(index.sparkSession, folder_uri))
    kinds = {"page_id": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    schema = "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    if payloads:
        kinds["payload"], schema = pa.binary(), f"{schema}, payload binary"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(origin)
        name, file = None, None
        for b in batches:
            rows, held = [], 0
            for r in b.to_pylist():
                if r["archive"] != name:
                    if file is not None:
                        file.close()
                    name, file = r["archive"], store.open_input_file(f"{folder}/{r['archive']}")
                file.seek(r["offset"])
                fields, _, block = next(records(inflated(io.BytesIO(file.read(r["length"])).read)))
                kind, digest, size, payload = fields["warc-type"], r["payload_digest"], r["payload_bytes"], None
                if kind == "response":
                    payload = memoryview(block)[block.find(_END) + len(_END) :]
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    if digest != r["payload_digest"]:
                        raise ValueError(f"the payload of page {r['page_id']} has changed")
                row = (_page(fields["warc-record-id"]), kind, _page(fields.get("warc-refers-to")), digest, size)
                if payloads:
                    row, held = (*row, None if payload is None else bytes(payload)), held + size * (payload is not None)
                rows.append(row)
                if held >= batch_bytes or len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return index.mapInArrow(each, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives, normalise these and read them back: a row for each page."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    raw, neat = shared_folder(spark, "archives"), shared_folder(spark, "members")
    write_archives(pages, raw)
    read = read_records(normalise(spark, raw, neat), neat, payloads=False)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
