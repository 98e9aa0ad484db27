"""WARC archives: dictionary-compressed writer and reader.

One WARC/1.1 record per page, each compressed as a Zstandard frame of its own.
An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, built from the records of that archive, however few they are;
decoders that know the layout load it, all others skip it.

Records with equal payloads of at least ``MIN_SHARED`` bytes: the one with the
smallest page id is a ``response``, the others are ``revisit`` records without
a payload that refer to it.  Smaller payloads are always responses.

Archives are written by Spark's text writer, so they go to any file system and
survive lost executors: a row is the bytes of one frame, and the line separator
is an empty skippable frame, which every Zstandard decoder ignores.  A task
closes an archive after ``RECORDS`` records or ``ARCHIVE_BYTES`` of records,
whichever is first: memory is bounded by that and by one page.

Defined cases: null html is an empty payload, null url leaves out the target
URI's own text (the record's URI is then ``urn:page:<id>``), a null page id
leaves out the id header and takes part in no group as its response (a group of
null ids only consists of responses); rows that share the smallest id of a group
are all responses; an empty table gives no archive and an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.llm.common import stored

MIN_SHARED = 100
RECORDS = 2000
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: Magic number of the skippable frame that holds an archive's dictionary.
DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_STEP = 1 << 14
_CRLF = b"\r\n"
_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "target_uri string, record_id string, payload binary")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """The uncompressed WARC record of one page."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", " ".join(url.split()) if url and url.split() else f"urn:page:{page_id}"),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Type", "application/http; msgtype=response"))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" \
            + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head.append(("Content-Length", str(len(block))))
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head), b"", b""]
    return _CRLF.join(lines) + block + _CRLF * 2


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of up to an eighth of the records: trained, or, where they
    are too few or too small for that, the beginnings of some of them as they
    are (Zstandard takes any content as a dictionary)."""
    size = min(DICT_BYTES, max(sum(map(len, records)) // 8, 256))
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        some = records[::-(-len(records) // 8)]
        return b"".join(r[:max(size // len(some), 32)] for r in some)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, then one per record."""
    trained = build_dictionary(records)
    yield struct.pack("<II", DICT_MAGIC, len(trained)) + trained
    loaded = zstandard.ZstdCompressionDict(trained)
    loaded.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=loaded)
    for r in records:
        yield packer.compress(r)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive."""
    at, unpacker = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICT_MAGIC and size:
                loaded = zstandard.ZstdCompressionDict(data[at + 8:at + 8 + size])
                unpacker = zstandard.ZstdDecompressor(dict_data=loaded)
            at += 8 + size
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            parts.append(frame.decompress(data[at:at + _STEP]))
            at += min(_STEP, len(data) - at)
        at -= len(frame.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(_CRLF * 2)
        first, *lines = head.decode("utf-8").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        yield headers, rest[:int(headers["Content-Length"])]


def _decided(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to) per page: refers_to is the
    response's page id where the page is a revisit."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= MIN_SHARED
    # only payloads that occur more than once; a hot payload is one row per task before the shuffle
    shared = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select(F.col("digest").alias("shared"), "first")
    met = rows.join(stored(shared, "warc-shared"), large & (F.col("digest") == F.col("shared")), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Write one record per page to archives under ``path``."""
    size = RECORDS + 1  # rows of an archive: the dictionary and the records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0

        def flush(last: bool) -> pa.RecordBatch:
            frames = list(archive(held))
            # the writer starts a file every ``size`` rows; null rows fill an archive that ends early
            frames += [None] * (0 if last else size - len(frames))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:2]] + [b.column(2).cast(pa.large_binary()).to_pylist()] \
                + [c.to_pylist() for c in b.columns[3:]]
            for page_id, url, html, digest, refers_to in zip(*cols):
                held.append(record(page_id, url, html, digest, refers_to, refers_to is not None))
                held_bytes += len(held[-1])
                if len(held) == RECORDS or held_bytes >= ARCHIVE_BYTES:
                    yield flush(False)
                    held_bytes = 0
        if held:
            yield flush(True)

    frames = _decided(pages, id_col, url_col, html_col).mapInArrow(run, "frame binary")
    # a cast to string keeps the bytes as they are, and the writer writes them unchanged
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR) \
        .option("maxRecordsPerFile", size).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: payload_bytes and
    payload_digest are those of the full payload; payload is null for revisits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(_row(head, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _SCHEMA)


def _row(head: dict[str, str], block: bytes) -> tuple:
    def number(key: str) -> int | None:
        return int(head[key]) if key in head else None

    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None
    if head["WARC-Type"] == "response":
        payload = io.BytesIO(block[block.index(_CRLF * 2) + 4:]).getvalue()
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    size = len(payload) if payload is not None else number("X-Payload-Length")
    return (number("X-Page-ID"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID"),
            head["WARC-Target-URI"], head["WARC-Record-ID"], payload)


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to archives under ``path`` and read them back."""
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
