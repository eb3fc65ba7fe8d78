"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress independently.  An archive ends with a skippable frame that holds the
seek table of the public Zstandard seekable format: compressed and decompressed size of each frame.  The index that
comes back from writing maps record identifiers to (archive, frame, offset in the frame), so one record costs one frame.
An identifier is made of the page's id and its payload's digest, so rows that share an id, or have none, are told apart.

Equal payloads are stored once: the record of the largest id is the response, the others are revisit records that name
it in WARC-Refers-To.  A task writes archives of bounded size to the shared folder through Arrow's file systems, each
under a temporary name first and then renamed, so a repeated or lost task leaves no half archive; what an attempt wrote
that Spark then did not count is named in no index.  The folder must be in a store that Arrow's file systems open (a
shared mount, HDFS, S3, GCS, Azure by their own schemes); pages are read by Spark from anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.reduce import split
from quantloom.llm.scratch import new_path, table

FRAME_BYTES = 256 << 10
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes of frames that one task reads.
READ_BYTES = 4 << 20
LEVEL = 3

# Fixed values of the public seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or of an absolute local path."""
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, kind: str, uri: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block and refers to the page that has the payload."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}:{sha1}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}:{sha1}>")
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split("\r\n")[1:])
        body, size = end + 4, int(headers["Content-Length"])
        yield at, headers, data[body : body + size]
        at = body + size + 4


class ArchiveWriter:
    """Writes one archive; ``add`` returns (frame number, offset in the frame)."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = file_system(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.frame = bytearray()
        self.sizes: list[tuple[int, int]] = []
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        place = len(self.sizes), len(self.frame)
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.written += len(packed)
            self.frame = bytearray()

    def close(self) -> list[tuple[int, int]]:
        """Writes the seek table and gives the archive its name; returns each frame's (offset, compressed size)."""
        self._flush()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(self.part, self.path)
        frames, at = [], 0
        for size, _ in self.sizes:
            frames.append((at, size))
            at += size
        return frames


class ArchiveReader:
    """Reads frames and records of one archive by its seek table."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table_ = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table_):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        _, headers, block = next(parse(self.frame(frame)[offset:]))
        return headers, block


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row below ``path``; returns the index (record_id, archive, frame, frame_bytes, offset).

    The payload is the html in UTF-8, empty for null; a record longer than a frame has one of its own.  A row with a null
    id is stored under the id ``null`` and is never what others refer to; rows that repeat both the largest id and the
    payload are all responses, with equal records under one identifier.  An empty table writes nothing; columns but the
    three are not read.  Payload equality is by SHA-1 and length.  Only html that others may share passes a shuffle.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "utf-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    keys = rows.select("sha1", F.length("payload").alias("n"), "page_id").groupBy("sha1", "n").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("c"))
    # Only payloads met more than once need the join; all others are responses.
    shared = table(keys.where("c > 1").select("sha1", "owner"), "shared_payloads")
    maybe, single = split(rows, ["sha1"], shared)
    joined = maybe.join(shared, "sha1", "left").select("page_id", "url", "payload", "owner").union(single.select("page_id", "url", "payload", F.lit(None).cast("long").alias("owner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, index = None, []

        def done():
            frames = writer.close()
            columns = list(zip(*index, strict=True))
            sizes = [frames[f][1] for f in columns[1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array([name] * len(index)), pa.array(columns[1], pa.int32()), pa.array(sizes, pa.int64()), pa.array(columns[2], pa.int64())],
                names=["record_id", "archive", "frame", "frame_bytes", "offset"],
            )

        for batch in batches:
            for i, uri, data, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.zst"
                    writer, index = ArchiveWriter(name), []
                name_ = "null" if i is None else str(i)
                refers = None if owner is None or owner == i else str(owner)
                data = bytes(data)
                sha1 = digest(data)
                text = record(name_, "response" if refers is None else "revisit", uri, data, sha1, refers)
                index.append((f"{name_}:{sha1}", *writer.add(text)))
                if writer.written >= ARCHIVE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    out = joined.mapInArrow(run, "record_id string, archive string, frame int, frame_bytes long, offset long")
    return table(out, "warc_index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the frames in ``index``: record_id, page_id, record_type, refers_to, url, payload_bytes, payload_digest, block.

    Frames are found by each archive's own seek table and dealt out in runs of about ``READ_BYTES``, so a large archive
    is read by many tasks and their number follows the size of the archives, not of the index.  page_id is null for a
    page without id; refers_to is the page that a revisit refers to.
    """
    frames = index.select("archive", "frame", "frame_bytes").distinct()
    total = frames.agg(F.sum("frame_bytes")).first()[0] or 0
    frames = frames.repartitionByRange(max(1, -(-total // READ_BYTES)), "archive", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, reader = None, None
        for batch in batches:
            for name, frame in sorted(zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)):
                if name != archive:
                    archive, reader = name, ArchiveReader(name)
                rows = []
                for _, h, block in parse(reader.frame(frame)):
                    own, other = h["WARC-Record-ID"][10:-1], h.get("WARC-Refers-To", "")[10:-1]
                    page, refers = own.partition(":")[0], other.partition(":")[0]
                    rows.append((own, None if page == "null" else int(page), h["WARC-Type"], int(refers) if refers else None, h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], block))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["record_id", "page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "block"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return frames.mapInArrow(run, "record_id string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, block binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Per page what came back from the archives; a null html is an empty payload, null and repeated ids give a row each."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    read = read_archives(index)
    # A response's digest is taken again from the block that came back.
    sha = F.when(F.col("record_type") == "response", F.sha1("block"))
    return read.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        sha.alias("block_sha1"),
        F.when(F.col("record_type") == "response", F.length("block").cast("long")).alias("block_bytes"),
    )


def _base32(hexadecimal: str) -> str:
    """SQL for the base-32 form of a 40-digit hexadecimal string."""
    alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    parts = [
        f"substr({alphabet}, 1 + ((('0x' || substr({hexadecimal}, {5 * g + 1}, 5))::BIGINT >> {5 * (3 - c)}) & 31)::BIGINT, 1)" for g in range(8) for c in range(4)
    ]
    return " || ".join(parts)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_base32('x')} AS payload_digest,
       CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner IS NULL OR owner = page_id THEN NULL ELSE owner END AS refers_to,
       CASE WHEN owner IS NULL OR owner = page_id THEN x END AS block_sha1,
       CASE WHEN owner IS NULL OR owner = page_id THEN strlen(h)::BIGINT END AS block_bytes
FROM o
"""
