"""WARC archives in Zstandard frames: writing, and reading with checks.

An archive starts with a skippable frame that carries the dictionary; after it every record is
one frame, compressed with that dictionary.  The dictionary is trained on a bounded sample of
payloads (``SAMPLE`` records of at most ``SAMPLE_BYTES`` bytes each).

Writing: of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
smallest id is a response, the others are revisits without payload.  Each task writes archives
of about ``ARCHIVE_BYTES`` into the shared folder, under names of its own attempt, and returns
their paths; the list of paths is a table that Spark commits, so files of lost attempts are
never read.

Reading: the dictionary is loaded from the leading frame, frames are decoded one by one from a
buffered stream, and every record is held against its headers: version line, known type,
declared and real lengths, the blank lines at its end, the payload's length and digest.  A
record that fails gives a row whose ``problem`` says why; a broken frame ends its archive.

Null payloads are empty.  Rows with a null id are written and read back with a null id, and
are never revisited (their record could not be named).  A null URL leaves its header out.
Rows that repeat an id are records of their own.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import as_bytes, map_batches
from trailmetrics.session import fresh_path, materialize

LEAST_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 14, 1 << 15
READ_BYTES = 1 << 20
ARCHIVES_A_TASK = 16
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
ID_PREFIX, NO_ID = "urn:page:", "none"

PARSED = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, payload string, problem string, archive string"
)


class BadRecord(ValueError):
    """A record that contradicts its own headers."""


def record_name(page_id: int | None) -> str:
    return f"<{ID_PREFIX}{NO_ID if page_id is None else page_id}>"


def id_in(name: str) -> int | None:
    found = re.fullmatch(rf"<{ID_PREFIX}(-?\d+|{NO_ID})>", name)
    if not found:
        raise BadRecord(f"record name {name!r}")
    return None if found[1] == NO_ID else int(found[1])


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None
) -> bytes:
    """A response record, or with ``refers_to`` a revisit of that record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"),
               ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", RECORD_DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"),
                ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def header_lines(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"header line {line[:40]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


@dataclass
class Record:
    page_id: int | None = None
    length: int | None = None
    digest: str | None = None
    kind: str | None = None
    refers_to: int | None = None
    url: str | None = None
    payload: bytes | None = None
    problem: str | None = field(default=None)


def number(headers: dict[str, str], name: str) -> int:
    value = headers.get(name, "")
    if not value.isdigit():
        raise BadRecord(f"{name} is {value!r}")
    return int(value)


def parse_record(data: bytes) -> Record:
    """Check a record against its own headers."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not blank:
        raise BadRecord(f"version line {version[:20]!r}")
    headers = header_lines(lines)
    length = number(headers, "content-length")
    if rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"block of {len(rest) - 4} bytes, {length} declared")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not status.startswith(b"HTTP/") or not blank:
        raise BadRecord(f"status line {status[:20]!r}")
    declared = number(header_lines(lines), "content-length")
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:")
    found = Record(id_in(headers.get("warc-record-id", "")), declared, digest, kind, None,
                   headers.get("warc-target-uri"))
    if kind == "response":
        if len(payload) != declared:
            raise BadRecord(f"payload of {len(payload)} bytes, {declared} declared")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise BadRecord("payload differs from its digest")
        found.payload = payload
    elif kind == "revisit":
        found.refers_to = id_in(headers.get("warc-refers-to", ""))
        if payload or headers.get("warc-profile") != REVISIT_PROFILE or not re.fullmatch("[0-9a-f]{64}", digest):
            raise BadRecord("revisit with a payload, or without profile or digest")
    else:
        raise BadRecord(f"record type {kind!r}")
    return found


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)


def frames(stream: io.RawIOBase) -> Iterator[bytes]:
    """Decoded content of each frame after the dictionary frame."""
    head = stream.read(8)
    magic, length = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame at the start")
    dictionary = stream.read(length)
    if len(dictionary) != length:
        raise BadRecord("dictionary frame cut short")
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decoder = zstandard.ZstdDecompressor(dict_data=known)
    left = stream.read(READ_BYTES)
    while left:
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not left:
                raise BadRecord("frame cut short")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else stream.read(READ_BYTES)
        yield b"".join(parts)
        left = left or stream.read(READ_BYTES)


def read_records(stream: io.RawIOBase) -> Iterator[Record]:
    try:
        for data in frames(stream):
            try:
                yield parse_record(data)
            except (BadRecord, UnicodeDecodeError) as error:
                yield Record(problem=str(error))
    except (BadRecord, zstandard.ZstdError) as error:
        yield Record(problem=f"archive: {error}")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the ``SAMPLE`` short payloads of least hash; empty if there are too few."""
    size = F.octet_length("html")
    usable = pages.filter((size >= LEAST_REVISIT) & (size <= SAMPLE_BYTES) & F.col("page_id").isNotNull())
    # The ids first: a sorted limit sends its rows from every task to the driver.
    ids = [row["page_id"] for row in usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()]
    sample = usable.filter(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id"]).orderBy(
        "page_id").collect() if ids else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [row["html"].encode() for row in sample]).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


def planned_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), n_bytes, digest and refers_to (null for responses)."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("n_bytes", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    # Short payloads get keys of their own, so that no task gathers them.
    keyed = rows.withColumn("key", F.when(F.col("n_bytes") >= LEAST_REVISIT, F.col("digest")).otherwise(
        F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    first = keyed.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("key").agg(F.min("page_id").alias("first_id"))
    again = F.col("page_id") > F.col("first_id")
    return keyed.join(first, "key", "left").select(
        "page_id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("html")).alias("html"), "n_bytes", "digest",
        F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; a stored table of the archives' paths."""
    dictionary = train_dictionary(pages)
    folder = fresh_path(pages.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        pack, attempt = compressor(dictionary), uuid.uuid4().hex
        out, name, size, done = None, "", 0, 0
        for batch in batches:
            columns = [as_bytes(c) if pa.types.is_string(c.type) and i == 2 else c.to_pylist()
                       for i, c in enumerate(batch.columns)]
            for page_id, url, html, n_bytes, digest, refers_to in zip(*columns):
                if out is None:
                    name = f"{attempt}-{done}.warc.zst"
                    out, size = store.open_output_stream(f"{root}/{name}"), 0
                    out.write(dictionary_frame(dictionary))
                data = pack.compress(record_bytes(page_id, url, html or b"", n_bytes, digest, refers_to))
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    out, done = None, done + 1
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    return materialize(map_batches(planned_records(pages), work, "path string"), "warc-list")


def read_archives(paths: DataFrame) -> DataFrame:
    """One row per record of the archives in ``paths`` (path string); the schema is ``PARSED``."""
    def rows(found: list[Record], archive: str) -> pa.RecordBatch:
        strings, longs = pa.string(), pa.int64()
        return pa.RecordBatch.from_arrays([
            pa.array([r.page_id for r in found], longs), pa.array([r.length for r in found], longs),
            pa.array([r.digest for r in found], strings), pa.array([r.kind for r in found], strings),
            pa.array([r.refers_to for r in found], longs), pa.array([r.url for r in found], strings),
            pa.array([r.payload for r in found], pa.binary()).cast(strings, safe=False),
            pa.array([r.problem for r in found], strings), pa.array([archive] * len(found), strings),
        ], names=[f.split()[0] for f in PARSED.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = file_system(path)
                with store.open_input_stream(name) as stream:
                    held: list[Record] = []
                    for record in read_records(stream):
                        held.append(record)
                        if len(held) == 256:
                            yield rows(held, path)
                            held = []
                    if held:
                        yield rows(held, path)

    archives = paths.count()
    tasks = max(min(archives, 2 * paths.sparkSession.sparkContext.defaultParallelism), archives // ARCHIVES_A_TASK, 1)
    return map_batches(paths.repartition(tasks), work, PARSED)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and say what each record holds."""
    return read_archives(write_archives(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
