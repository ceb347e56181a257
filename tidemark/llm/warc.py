"""Dictionary-compressed WARC archives.

Each archive begins with a skippable frame that holds a Zstandard dictionary trained on records of
that archive; every record follows as a frame of its own. Of records with one payload the page with
the smallest id is written as response, the others as revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small, table, written

MAGIC = 0x184D2A5D
TRAIN_BYTES = 1_000_000
"""The dictionary of an archive is trained on its first records up to so many bytes."""
TRAIN_RECORD = 32_768
DICTIONARY = 32_768
ARCHIVE_BYTES = 64_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("8a1f6a4e-6a0e-4f0e-9d3b-0d5c1b0e7a11")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def _line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP headers only; the payload's length and digest stay in its headers."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or '') or 'urn:page:' + str(page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Archive:
    """One .warc.zst file, written under a name of this attempt and renamed when it is whole."""

    def __init__(self, uri: str, train_bytes: int = TRAIN_BYTES):
        self.train_bytes = train_bytes
        self.uri, (self.fs, self.path) = uri, place(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.held: list[bytes] | None = []
        self.waiting = self.bytes = self.records = 0
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.held is None:
            self._frame(data)
            return
        self.held.append(data)
        self.waiting += len(data)
        if self.waiting >= self.train_bytes:
            self._start()

    def _start(self) -> None:
        dictionary = None
        try:
            samples = [d[:TRAIN_RECORD] for d in self.held]  # of each record as much as tells the dictionary what recurs
            dictionary = zstd.train_dictionary(min(DICTIONARY, self.waiting // 8), samples)
        except zstd.ZstdError:
            pass  # too few records to train on: plain frames, without a leading one
        if dictionary is not None:
            body = dictionary.as_bytes()
            self._put(struct.pack("<II", MAGIC, len(body)) + body)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=dictionary)
        held, self.held = self.held, None
        for data in held:
            self._frame(data)

    def _frame(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self._start()
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.uri, self.records, self.bytes


def write_archives(
    pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = 100,
    archive_bytes: int = ARCHIVE_BYTES, train_bytes: int = TRAIN_BYTES,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; returns (path, records, bytes), one row per archive.

    Null html is an empty payload. Payloads of at least ``least`` bytes that occur more than once are
    written as response for the smallest page_id (each of its repeated rows) and as revisits for the
    others; rows without a page_id never count as smallest. A task that runs again replaces its files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    counted = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = written(counted.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    decided = rows.join(small(again), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, archive, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.slice(at, 200).columns]):
                    if archive is None:
                        archive = Archive(f"{folder}/part-{part:06d}-{n:04d}.warc.zst", train_bytes)
                    archive.add(record(page_id, url, html.encode(), digest, refers_to, date))
                    if archive.bytes >= archive_bytes:
                        done.append(archive.close())
                        archive, n = None, n + 1
        if archive is not None:
            done.append(archive.close())
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["path", "records", "bytes"])

    return written(decided.mapInArrow(run, "path string, records long, bytes long"))


def frames(uri: str) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time."""
    filesystem, path = place(uri)
    with filesystem.open_input_stream(path, compression=None) as f:
        lead, dictionary = f.read(8), None
        magic, size = struct.unpack("<II", lead) if len(lead) == 8 else (0, 0)
        if magic == MAGIC:
            dictionary, lead = zstd.ZstdCompressionDict(f.read(size)), b""
        decompressor = zstd.ZstdDecompressor(dict_data=dictionary)
        data = lead or f.read(65_536)
        while data:
            frame, parts = decompressor.decompressobj(), []
            while not frame.eof:
                if not data:
                    raise ValueError(f"{uri} ends inside a frame")
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else f.read(65_536)
            yield b"".join(parts)
            data = data or f.read(65_536)


def records_of(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; one record is held at a time."""
    for data in frames(uri):
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(headers["Content-Length"])
        if len(rest) != length + 4:
            raise ValueError(f"{uri}: a record of {len(rest) - 4} bytes says {length}")
        yield headers, rest[:length]


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of every record of the archives in
    column ``path``. For a response the last figures are taken from its payload, for a revisit from its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, block in records_of(path):
                    payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                    length = len(payload) if payload is not None else int(h["X-Payload-Length"])
                    digest = hashlib.sha256(payload).hexdigest() if payload is not None else h["WARC-Payload-Digest"].partition(":")[2]
                    rows.append((number(h["X-Page-ID"]), h["WARC-Target-URI"], h["WARC-Type"], payload, length, digest, number(h.get("X-Refers-To-Page-ID"))))
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(
        run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op9_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
}


def registered() -> dict:
    return {"op9_warc": op9_warc}
