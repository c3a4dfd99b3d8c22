"""WARC archives, each compressed record by record with a Zstandard dictionary of its own.

A partition's records go to archives of about ``roll`` bytes. The first records of an archive
train its dictionary, which leads the file in a skippable frame (magic 0x184D2A5D); every
record is a frame of its own. Readers walk the frames and need nothing else.

Records with equal payloads are found by digest: an aggregation (combined before the
shuffle) gives each digest's largest page_id, for those that several records have. A join brings it
to the pages: by broadcast where these digests are counted to be at most ``MAX_BROADCAST``, so no
payload is moved; else by a shuffle, of which adaptive execution splits a hot digest. Every task attempt writes archives under names of its own and
only names that a finished task returned are read, so lost executors leave no wrong files.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other, and
if all of a group are null each is a response; rows that share the largest page_id of their
group are all responses; a null url gets a target made from the page_id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, read_bytes, settle, text_or_empty, write_bytes

DICT_MAGIC = 0x184D2A5D
ROLL = 48 << 20
SAMPLE = 2 << 20
#: Digests (28 bytes each) that are broadcast at most.
MAX_BROADCAST = 500_000


def _clean(s: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in s)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the record of refers_to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{name}'}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class Archive:
    """A .warc.zst file in the making."""

    def __init__(self, level: int = 3):
        self.level, self.waiting, self.size, self.packer, self.out, self.n = level, [], 0, None, bytearray(), 0

    def add(self, rec: bytes) -> None:
        self.n += 1
        self.size += len(rec)
        if self.packer:
            self.out += self.packer.compress(rec)
            return
        self.waiting.append(rec)
        if self.size >= SAMPLE:
            self._start()

    def _start(self) -> None:
        words = None
        try:
            words = zstandard.train_dictionary(min(112 << 10, max(1 << 10, self.size // 16)), self.waiting, k=256, d=8)
        except zstandard.ZstdError:
            pass  # too little to learn from: a valid archive without a dictionary
        if words:
            data = words.as_bytes()
            self.out += struct.pack("<II", DICT_MAGIC, len(data)) + data
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True)
        for r in self.waiting:
            self.out += self.packer.compress(r)
        self.waiting = []

    def close(self) -> bytes:
        if self.packer is None:
            self._start()
        return bytes(self.out)


def records(data: bytes) -> Iterator[bytes]:
    """The records of a .warc.zst file."""
    at, words, view = 0, None, memoryview(data)
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICT_MAGIC and at == 0:
                words = zstandard.ZstdCompressionDict(data[8 : 8 + n])
                if data[8:12] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
            at += 8 + n
            continue
        d = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        parts = []
        while not d.eof:
            if at >= len(data):
                raise ValueError("archive ends within a record")
            piece = view[at : at + 16384]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def parse(rec: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of a record; a response's
    payload is checked against its digest."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda s: None if s in (None, "null") else int(s)
    name = lambda k: number(fields[k].removeprefix("<urn:page:").removesuffix(">")) if k in fields else None
    return {"page_id": name("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": name("WARC-Refers-To"), "url": fields["WARC-Target-URI"]}


def with_revisits(pages: DataFrame, min_bytes: int = 0, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, html and refers_to: null for responses, else the page whose payload is equal."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    p = p.withColumn("digest", F.unhex(F.sha1("html")))
    groups = p.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    groups = settle(groups.select("digest", "first"), "warc-digests")
    groups = F.broadcast(groups) if groups.count() <= max_broadcast else groups
    far = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return p.join(groups, "digest", "left").select("page_id", "url", "html", far.alias("refers_to"))


def write(pages: DataFrame, path: str, roll: int = ROLL, level: int = 3, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages (page_id, url, html) below path; returns the finished ones: path, records, bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(level)

        def close() -> pa.RecordBatch:
            name, data = f"{path}/{uuid.uuid4().hex}.warc.zst", archive.close()
            write_bytes(name, data)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [archive.n], "bytes": [len(data)]})

        for b in batches:
            for row in b.to_pylist():
                archive.add(record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["refers_to"]))
                if archive.size >= roll:
                    yield close()
                    archive = Archive(level)
        if archive.n:
            yield close()

    done = with_revisits(pages, min_bytes).mapInArrow(task, "path string, records long, bytes long")
    return settle(done, "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives named in manifest, one row each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for rec in records(read_bytes(name)):
                    rows.append(parse(rec))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # one archive is a task's work, however few rows name them
    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 10_000)).mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return read(write(pages, fresh_path(pages.sparkSession, "warc"), min_bytes=min_bytes))


#: The digest's 160 bits, twenty at a time, are four characters each.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda j: CAST('0x' || substr(d, CAST(5 * j + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM f)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
