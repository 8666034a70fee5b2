"""WARC archives: write crawled pages, normalise whole-file gzip streams into one member a record, read by offset.

A *monolithic* archive is a single gzip stream, so nothing in it can be read without inflating all before it. The
normaliser inflates such a file once, front to back, rewrites each record as a gzip member of its own and writes a
sidecar index of offsets and lengths; after that any record is one seek and one inflate away. Files are read and
written by tasks through Arrow's file systems, in the shared folder, under a temporary name that is then moved, so a
task that runs twice leaves one file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.storage import new_path, remove, written

#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Rows of repeated payloads (a digest and an id, about 100 bytes) that may be broadcast: 20 MB at most.
BROADCAST_REPEATS = 200_000
ROLL_BYTES = 64_000_000
_DATE = "2024-01-01T00:00:00Z"
_READ = 1 << 20


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null for a response), refers_url (the response's).

    Of equal payloads of ``min_bytes`` or more the smallest page_id is the response and the others refer to it. Null
    html is an empty payload; rows that repeat the response's id are responses too; a null id is never the response
    while the group has another. Of rows that share the response's id and payload, revisits name that of the least url.
    An empty table stays empty; extra columns are not read.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    repeats = base.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("r"), F.count("*").alias("n")).where("n > 1 and r is not null")
    repeats = written(repeats.select("digest", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url")), "warc-repeats")
    if repeats.count() <= broadcast_repeats:
        repeats = F.broadcast(repeats)
    out = base.join(repeats, "digest", "left")
    response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(~response, F.col("first")).alias("refers_to"), F.when(~response, F.col("first_url")).alias("refers_url"))


def _quoted(v: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in v or "")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The id of a record by its page, address and payload, so that a revisit can name that of its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """The bytes of one WARC record. A revisit has no body; its length and digest headers are those of the full payload.

    A revisit names its response's record id and address in the standard's headers, and its page in one of our own.
    """
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_quoted(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Target-URI: {_quoted(refers_url)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


class _Placed:
    """A file written under a temporary name and moved into place when complete."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, b: bytes) -> None:
        self.out.write(b)
        self.size += len(b)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temp, self.path)


def write_archives(classified: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 1) -> DataFrame:
    """Writes the rows of ``classify`` as monolithic ``.warc.gz`` files, at least one file a task that has rows; returns (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, n, raw = TaskContext.get().partitionId(), 0, 0, 0
        out = gz = None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")), strict=True):
                if out is None:
                    path, gz, n, raw = f"{folder}/part-{part:05d}-{k:04d}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = _Placed(path)
                data = record(row[0], row[1], row[2].encode(), *row[3:])
                out.write(gz.compress(data))
                n, raw = n + 1, raw + len(data)
                if raw >= roll_bytes:
                    out.write(gz.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
                    out, k = None, k + 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return classified.select("page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(run, "path string, records bigint")


def _inflated(uri: str) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, read once."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z, data = zlib.decompressobj(31), f.read(_READ)
        while data:
            yield z.decompress(data)
            data = z.unused_data or f.read(_READ)
            if z.eof and data:
                z = zlib.decompressobj(31)
        if not z.eof:
            raise ValueError(f"{uri}: the gzip stream is cut short")


def stream_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, raw record) of each record in an archive. Memory is bounded by the largest record."""
    buf, chunks = bytearray(), _inflated(uri)

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while fill(1):
        seen = 0
        while (end := buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buf)
            if not fill(seen + 1):
                raise ValueError(f"{uri}: a record's headers are cut short")
        head = parse_head(bytes(buf[:end]))
        total = end + 4 + int(head["content-length"]) + 4
        if not fill(total):
            raise ValueError(f"{uri}: a record's body is cut short")
        yield head, bytes(buf[:total])
        del buf[:total]


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites each archive of ``archives`` (a ``path`` column) under ``folder`` with a gzip member a record and a sidecar ``.idx``; returns the index.

    The index rows are (path, offset, length, page_id). The sidecar has ``offset length page_id`` a line, and is
    written after its archive: an archive with a sidecar is complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                path = f"{folder}/{uri.rpartition('/')[2]}"
                out, rows = _Placed(path), []
                for head, raw in stream_records(uri):
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = gz.compress(raw) + gz.flush()
                    rows.append((out.size, len(member), int(head["x-page-id"]) if head.get("x-page-id") else None))
                    out.write(member)
                out.close()
                side = _Placed(f"{path}.idx")
                side.write("".join(f"{o} {n} {'' if p is None else p}\n" for o, n, p in rows).encode())
                side.close()
                o, n, p = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64())], ["path", "offset", "length", "page_id"])

    return archives.select("path").mapInArrow(run, "path string, offset bigint, length bigint, page_id bigint")


def read_records(index: DataFrame) -> DataFrame:
    """One row per indexed record, read by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    A response's digest is computed from its bytes and must equal its header; a revisit's is its header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        uri, f = None, None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if path != uri:
                    fs, local = pafs.FileSystem.from_uri(path)
                    uri, f = path, fs.open_input_file(local)
                f.seek(offset)
                raw = zlib.decompress(f.read(length), 31)
                end = raw.index(b"\r\n\r\n")
                head = parse_head(raw[:end])
                kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                size = int(head["x-payload-length"])
                if kind == "response":
                    body = raw[end + 4 : -4]
                    if hashlib.sha256(body).hexdigest() != digest or len(body) != size:
                        raise ValueError(f"{path} at {offset}: the payload does not match its digest")
                ref = head.get("x-refers-to-page-id")
                rows.append((int(head["x-page-id"]) if head.get("x-page-id") else None, size, digest, kind, int(ref) if ref else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return index.select("path", "offset", "length").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_and_read(pages: DataFrame, keep_monolithic: bool = False, **kw) -> DataFrame:
    """Writes ``pages`` as monolithic archives, normalises them, and reads every record back through the index."""
    spark = pages.sparkSession
    raw, tidy = new_path(spark, "warc-monolithic"), new_path(spark, "warc")
    archives = written(write_archives(classify(pages, **kw), raw), "warc-archives")
    index = written(normalise(archives.repartition(spark.sparkContext.defaultParallelism * 2), tidy), "warc-index")
    if not keep_monolithic:
        remove(spark, raw)
    return read_records(index)
