"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding a group of WARC/1.1
records, and a skippable frame with the seek table of the Zstandard seekable format.
An index table maps every record identifier to its bundle, frame and place in the
frame, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, qualified, shuffle_partitions, written

#: Bytes of records in a frame, and of compressed frames in a bundle, about.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
#: Rows up to which the table of repeated payloads is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
# Fixed values of the Zstandard seekable format, and the archive's own.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names that Hadoop and pyarrow have for one scheme.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "record_id string, page_id long, bundle string, frame_at long, frame_bytes long, record_at long, record_bytes long"


def record_id(page_id: int | None, digest: str, copy: int | None = None) -> str:
    """The name of one record; copy tells rows of one page_id and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}' if copy is None else f'{page_id}/{digest}/{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, copy: int | None, alone: bool | None) -> bytes:
    """A response record with its payload, or a revisit record; that names the response by its identifier where there is one such row alone."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
        if alone:
            head.append(("WARC-Refers-To", record_id(refers_to, digest)))
    block = _HEAD + (payload if kind == "response" else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, HTTP body) of each record in a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        block = frame[end + 4 : end + 4 + size]
        yield fields, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes of the frames before it."""
    body = b"".join(struct.pack("<II", a, b) for a, b in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """[(offset, compressed, decompressed)] of the frames of an open bundle, from its last bytes."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("the bundle has no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - entry * n)
    table, out, at = file.read(entry * n), [], 0
    for i in range(n):
        a, b = struct.unpack_from("<II", table, entry * i)
        out.append((at, a, b))
        at += a
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified URI, and the path in it; what pyarrow has no file system for is an error."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> with payload, digest, kind, refers_to, copy and alone.

    Of equal payloads of LEAST_BYTES or more, those of the largest page_id are responses.
    Rows of one page_id and payload have different copy numbers; alone tells whether the
    response of a payload is one row.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    by = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("size"))
    repeated = by.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"), F.first("size").alias("size")).where("n > 1")
    large = (F.col("size") >= LEAST_BYTES) & F.col("top.page_id").isNotNull()
    repeated = repeated.select("digest", F.when(large, F.col("top.page_id")).alias("last"), F.col("top.page_id").alias("top"), (F.col("top.n") == 1).alias("alone"), (F.col("most") > 1).alias("twice"))
    repeated = written(repeated.where("last is not null or twice"), "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    copy = F.when(F.col("twice") & ~(F.col("alone") & F.col("page_id").eqNullSafe(F.col("top"))), F.monotonically_increasing_id())
    return joined.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("last")).alias("refers_to"), copy.alias("copy"), "alone")


def write_bundles(pages: DataFrame, path: str, *, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record a page into bundles under path, and the index beside them; returns the index as stored.

    Every task writes bundles of its own with names of their own, and only what a
    task that succeeded has written is in the index; a lost task is simply run again.
    Bundles go to the file system in which Spark looks for path, not to an executor's own.
    """
    uri = qualified(pages.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _open(uri)
        fs.create_dir(f"{root}/bundles", recursive=True)
        out, sizes, index, held, pending = None, [], [], [], 0
        name, at = "", 0
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

        def end_frame() -> None:
            nonlocal held, pending, at
            if not held:
                return
            raw = b"".join(r for _, _, r in held)
            frame = packer.compress(raw)
            place = 0
            for rid, page_id, r in held:
                index.append((rid, page_id, name, at, len(frame), place, len(r)))
                place += len(r)
            out.write(frame)
            sizes.append((len(frame), len(raw)))
            at += len(frame)
            held, pending = [], 0

        def end_bundle() -> Iterator[pa.RecordBatch]:
            nonlocal out, sizes, index
            if out is None:
                return
            end_frame()
            out.write(seek_table(sizes))
            out.close()
            out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["record_id", "page_id", "bundle", "frame_at", "frame_bytes", "record_at", "record_bytes"])
            sizes, index = [], []

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, kind, refers_to, copy, alone = (batch.column(j)[i].as_py() for j in range(8))
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(f"{root}/bundles/{name}", compression=None)
                held.append((record_id(page_id, digest, copy), page_id, record(page_id, url, payload, digest, kind, refers_to, copy, alone)))
                pending += len(held[-1][2])
                if pending >= frame_bytes:
                    end_frame()
                    if at >= bundle_bytes:
                        yield from end_bundle()
        yield from end_bundle()

    revisits(pages).mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _row(fields: dict[str, str], body: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def read_bundles(index: DataFrame, path: str) -> DataFrame:
    """Every record of the bundles in the index, read frame by frame from the seek tables; a response's digest is verified."""
    uri = qualified(index.sparkSession, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _open(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where = f"{root}/bundles/{name}"
                with fs.open_input_file(where) as file:
                    for at, size, _ in read_seek_table(file, file.size()):
                        file.seek(at)
                        raw = zstandard.ZstdDecompressor().decompress(file.read(size))
                        yield _batch([_row(*r) for r in parse_records(raw)])

    bundles = index.select("bundle").distinct().repartition(shuffle_partitions(index.sparkSession))
    return bundles.mapInArrow(read, RECORD)


def fetch(index: DataFrame, path: str) -> DataFrame:
    """The records of some index rows: each frame is read where it lies and cut at the record's offset."""
    uri = qualified(index.sparkSession, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _open(uri)
        last, raw = None, b""
        for batch in batches:
            rows = []
            for _, _, name, at, size, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, at) != last:
                    with fs.open_input_file(f"{root}/bundles/{name}") as file:
                        file.seek(at)
                        raw, last = zstandard.ZstdDecompressor().decompress(file.read(size)), (name, at)
                rows += [_row(*r) for r in parse_records(raw[place : place + n])]
            yield _batch(rows)

    return index.repartition(shuffle_partitions(index.sparkSession), "bundle", "frame_at").sortWithinPartitions("bundle", "frame_at").mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to bundles in the shared folder and read all records back.

    Null pages have an empty payload. Repeated page_ids each get a record, those of a
    repeated payload's largest page_id all as responses, and each with an identifier of
    its own; rows without page_id are kept. Control characters and spaces in urls are percent-encoded. Other columns are
    ignored; an empty table gives none.
    """
    path = new_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, path), path)
