"""WARC archives as seekable Zstandard bundles.

Every page becomes one WARC/1.1 record.  Records are grouped into independent
Zstandard frames of about ``FRAME_BYTES``; a bundle of frames ends with a seek
table (a skippable frame holding the sizes of all frames), so any frame can be
read alone.  The write job returns the index: record id -> bundle, frame and
offset inside the frame.

A task names its bundles after its attempt, and only attempts that Spark commits
are in the index, so retried or speculative tasks leave nothing that is read.
Bundles go to the shared folder (``spark.checkpoint.dir``) through pyarrow's file
systems.

Of pages with equal payloads the one with the smallest page_id is the response
and the others revisit it.  Only pages in hash buckets of repeated payloads are
shuffled to learn this; the html of all others stays where it was read.

Defined results: null html is an empty payload; rows that share the smallest
page_id of a payload are all responses; a null page_id is never referred to and
is a response unless a page with an id has its payload; a null url is written as
about:blank; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, bucket, in_buckets, shuffle_partitions, ship_package, table

FRAME_BYTES = 1 << 20       # of records in one frame, about
BUNDLE_BYTES = 64 << 20     # compressed bytes in one bundle, about
LEAST_REVISIT = 0           # smaller payloads are always responses
LEVEL = 3
SALTS = 16                  # parts of the pages with one payload

# FIXED VALUES of the seekable format and of WARC/1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, offset long, length long"


def file_system(uri: str):
    """pyarrow file system and path of a folder Spark names by URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, payload_sha: str, url: str | None) -> str:
    name = f"page:{page_id}" if page_id is not None else f"payload:{payload_sha}:{url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def make_record(page_id, url: str | None, payload: bytes, refers_to) -> tuple[str, bytes]:
    """(record id, record); a revisit has the HTTP head and no payload."""
    sha = payload_digest(payload)
    rid = record_id(page_id, sha, url)
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~"),
        f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        fields.append(f"X-Page-ID: {quote(str(page_id))}")
    if refers_to is not None:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}",
                   f"WARC-Refers-To: {record_id(refers_to, sha, None)}"]
    fields.append(f"Content-Length: {len(block)}")
    return rid, "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, end) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} does not end where its length says")
    return fields, data[start:stop], stop + 4


class BundleWriter:
    """Writes records into frames and ends the bundle with its seek table."""

    def __init__(self, out):
        self.out, self.sizes, self.size = out, [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.frame, self.length = [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        at = len(self.sizes), self.length
        self.frame.append(record)
        self.length += len(record)
        if self.length >= FRAME_BYTES:
            self.close_frame()
        return at

    def close_frame(self) -> None:
        if self.frame:
            z = self.zip.compress(b"".join(self.frame))
            self.out.write(z)
            self.sizes.append((len(z), self.length))
            self.size += len(z)
            self.frame, self.length = [], 0

    def close(self) -> None:
        self.close_frame()
        rows = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(foot)) + rows + foot)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the bundle's end."""
    end = f.seek(0, io.SEEK_END)
    f.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    f.seek(end - 9 - 8 * n)
    sizes = [struct.unpack("<II", f.read(8)) for _ in range(n)]
    out, at = [], 0
    for z, size in sizes:
        out.append((at, z, size))
        at += z
    return out


def read_frame(f, place: tuple[int, int, int]) -> bytes:
    f.seek(place[0])
    return zstandard.ZstdDecompressor().decompress(f.read(place[1]), max_output_size=place[2])


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and one frame."""
    fs, path = file_system(bundle)
    with fs.open_input_file(path) as f:
        fields, block, _ = parse_record(read_frame(f, seek_table(f)[frame]), offset)
    return fields, block


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        attempt = TaskContext.get().taskAttemptId()
        writer, rows, number = None, [], 0

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()),
                 ("offset", pa.int64()), ("length", pa.int64())]))

        for batch in batches:
            ids, first = batch.column("page_id").to_pylist(), batch.column("first").to_pylist()
            urls = batch.column("url").to_pylist()
            for i, page in enumerate(ids):
                if writer is None:
                    name = f"bundle-{attempt:010d}-{number:05d}.warc.zst"
                    writer, rows, number = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None)), [], number + 1
                refers = first[i] if first[i] is not None and first[i] != page else None
                rid, rec = make_record(page, urls[i], batch.column("body")[i].as_py() or b"", refers)
                frame, offset = writer.add(rec)
                rows.append({"record_id": rid, "bundle": f"{folder}/{name}", "frame": frame,
                             "offset": offset, "length": len(rec)})
                if writer.size >= BUNDLE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record of the named bundles, frame by frame."""
    for batch in batches:
        for bundle in batch.column("bundle").to_pylist():
            fs, path = file_system(bundle)
            with fs.open_input_file(path) as f:
                for place in seek_table(f):
                    data, at, rows = read_frame(f, place), 0, []
                    while at < len(data):
                        fields, block, at = parse_record(data, at)
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and payload_digest(payload) != sha:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match")
                        rows.append({
                            "page_id": unquote(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
                            "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
                            "payload_bytes": len(payload) if response else None, "payload_digest": sha,
                            "refers": fields.get("WARC-Refers-To")})
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                        [("page_id", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                         ("refers", pa.string())]))


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes the bundles and returns the index (record_id, bundle, frame,
    offset, length)."""
    spark = pages.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string"), body.alias("body"),
                        F.sha2(body, 256).alias("same"))
    many = scratch.write(
        rows.where(F.octet_length("body") >= LEAST_REVISIT).groupBy("same")
        .agg(F.min("page_id").cast("string").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("same", "first"), "many")
    rows = rows.withColumn("page_id", F.col("page_id").cast("string"))
    marks = F.broadcast(in_buckets(many, "same"))
    tagged = rows.withColumn("_b", bucket("same"))
    single = tagged.join(marks, "_b", "left_anti").withColumn("first", F.lit(None).cast("string"))
    shared = salted(tagged.join(marks, "_b", "left_semi")).join(spread(many), ["same", "salt"], "left")
    cols = ["page_id", "url", "body", "first"]
    folder = scratch.path("bundles")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    index = single.select(*cols).unionByName(shared.select(*cols)).mapInArrow(_write(folder), INDEX)
    return scratch.write(index, "index")


def salted(pages: DataFrame) -> DataFrame:
    """Pages in ``SALTS`` parts, so that copies of one payload are spread."""
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))


def spread(payloads: DataFrame) -> DataFrame:
    """One row a payload, for every part."""
    return payloads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def read_archives(index: DataFrame, scratch: Scratch, id_type: str = "long") -> DataFrame:
    """Rows of all records in the indexed bundles, page ids as ``id_type``; a
    revisit takes the payload size of the record it refers to.  Bundles are dealt over a fixed number of
    tasks: their names are few bytes, which says nothing of the work."""
    spark = index.sparkSession
    bundles = index.select("bundle").distinct().repartition(4 * shuffle_partitions(spark), "bundle")
    recs = scratch.write(bundles.mapInArrow(
        _read, "page_id string, record_id string, record_type string, payload_bytes long, "
               "payload_digest string, refers string"), "records")
    full = recs.where("record_type = 'response'")
    known = full.groupBy(F.col("record_id").alias("refers")).agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("full_bytes"))
    again = salted(recs.where("record_type = 'revisit'")).join(spread(known), ["refers", "salt"], "left")
    cols = [F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type",
            F.col("refers_to").cast(id_type)]
    return full.withColumn("refers_to", F.lit(None).cast("string")).select(*cols).unionByName(
        again.withColumn("payload_bytes", F.col("full_bytes")).select(*cols))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch), scratch)


SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST((i // 8) * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
"""
