"""WARC archives by way of a chunked record table.

Payloads travel as rows (record, chunk number, bytes) of at most CHUNK bytes, in writing and in reading, so no step
here holds a whole record. The writer streams chunk rows into gzip members, one per record; the reader streams
archives back into chunk rows, each with the SHA-256 of the payload up to its end, carried from chunk to chunk.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others are
revisits of it and store no payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, shared_dir, written
from .tokens import _filesystem

CHUNK = 1 << 15
READ = 1 << 16
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_table(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, refers_to, chunk_no, chunk) of a table of pages; chunks of a record stand together."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = keys.join(first, "payload_digest").where("page_id is null or page_id <> first").where("first is not null").select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()
    revisits = written(pages.sparkSession, revisits, "revisits")  # so that payloads are hashed twice and not once more for the size
    same = F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.payload_digest") == F.col("v.payload_digest"))
    rows = rows.alias("r").join(fits(revisits).alias("v"), same, "left").select("r.*", "v.refers_to")
    chunks = F.when(F.col("refers_to").isNotNull() | (F.col("payload_bytes") == 0), F.lit(0)).otherwise(F.floor((F.col("payload_bytes") - 1) / CHUNK).cast("int"))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), chunks)))
    chunk = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", chunk.alias("chunk"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    text = record_id.strip("<>").rpartition(":")[2]
    return None if text == "null" else int(text)


def _header(page_id, url, size, digest, refers_to) -> bytes:
    http = _HTTP % size
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Payload-Length: {size}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(root: str):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        filesystem, base = _filesystem(root)
        out = member = None
        name, records, size = "", 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                if columns[5][i].as_py() == 0:
                    if member is not None:
                        size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                        member = None
                        if size >= ARCHIVE_BYTES:
                            out.close()
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=schema)
                            out = None
                    if out is None:
                        filesystem.create_dir(base, recursive=True)
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    records += 1
                    size += out.write(member.compress(_header(*(c[i].as_py() for c in columns[:5]))))
                size += out.write(member.compress(columns[6][i].as_buffer()))
        if out is not None:
            size += out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=schema)

    return run


def write_warc(spark: SparkSession, pages: DataFrame, out_dir: str, least: int = 100) -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``out_dir``, a folder that all machines share.

    A null html is an empty payload; a null page_id is written as such. Rows of one page_id and one payload are all
    responses if that is the payload's smallest id. The table ``archives`` names the files of successful attempts.
    """
    shared_dir(spark)
    rows = record_table(pages, least).mapInArrow(_write(f"{out_dir}/data"), "file string, records long, bytes long")
    rows.write.parquet(f"{out_dir}/archives")


class _Stream:
    """Bytes of a file of gzip members, inflated as they are asked for."""

    def __init__(self, f):
        self.f, self.tool, self.buffer, self.rest, self.ended = f, zlib.decompressobj(31), bytearray(), b"", False

    def fill(self) -> bool:
        while not self.ended:
            if self.tool.eof:
                self.rest, self.tool = self.tool.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.f.read(READ)
            if not raw:
                self.ended = True
                break
            got = self.tool.decompress(raw, READ)
            self.rest = self.tool.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def line(self) -> bytes | None:
        at = 0
        while (end := self.buffer.find(b"\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 1)
            if not self.fill():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return out

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most and self.fill():
            pass
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out


def _headers(stream: _Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        key, _, value = line.decode().partition(":")
        out[key.lower()] = value.strip()
    return out


def records(stream: _Stream):
    """(page_id, url, type, refers_to, payload bytes by header, digest by header, chunk_no, chunk, digest so far)."""
    while (version := stream.line()) is not None:
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(stream)
        kind = head["warc-type"]
        length = int(head["content-length"])
        before = stream.line()
        http = _headers(stream)
        left = length - len(before) - 2 - sum(len(k) + len(v) + 4 for k, v in http.items()) - 2
        common = (_page_id(head["warc-record-id"]), head.get("warc-target-uri"), kind, _page_id(head["warc-refers-to"]) if "warc-refers-to" in head else None, int(head.get("x-payload-length", left)), head["warc-payload-digest"].partition(":")[2])
        running, number = hashlib.sha256(), 0
        if kind == "revisit":
            yield (*common, 0, b"", None)
            continue
        while True:
            chunk = stream.take(min(left, CHUNK))
            if len(chunk) < min(left, CHUNK):
                raise ValueError("a record breaks off")
            running.update(chunk)
            left -= len(chunk)
            yield (*common, number, chunk, running.copy().hexdigest())
            number += 1
            if not left:
                break


_CHUNKS = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("chunk_bytes", pa.int64()), ("digest", pa.string())])


def _read(root: str, payload: bool):
    def run(batches):
        filesystem, base = _filesystem(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, held, number = [], 0, -1
                    for page_id, url, kind, refers_to, size, digest, chunk_no, chunk, so_far in records(_Stream(f)):
                        number += chunk_no == 0
                        rows.append((name, number, page_id, url, kind, refers_to, size, digest, chunk_no, chunk if payload else None, len(chunk), so_far))
                        held += len(chunk)
                        if held > 1 << 23 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    return run


def read_warc(spark: SparkSession, out_dir: str, payload: bool = True) -> DataFrame:
    """The chunk table of all archives: one row per chunk, revisits one row without payload.

    digest: SHA-256 of the payload up to the chunk's end. ``payload`` False: chunk stays null.
    """
    files = spark.read.parquet(f"{out_dir}/archives").select("file").collect()  # one row per archive
    kind = "file string, record_no long, page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no int, chunk binary, chunk_bytes long, digest string"
    if not files:
        return spark.createDataFrame([], kind)
    names = spark.createDataFrame(spark.sparkContext.parallelize([(r.file,) for r in files], len(files)), "file string")
    return names.mapInArrow(_read(f"{out_dir}/data", payload), kind)


def archived(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a chunk table; a payload whose digest differs from its header's raises."""
    last = F.max(F.struct("chunk_no", "digest", "page_id", "record_type", "refers_to", "declared_bytes", "declared_digest")).alias("x")
    rows = chunks.groupBy("file", "record_no").agg(last, F.sum("chunk_bytes").alias("stored"))
    whole = F.col("x.record_type") == "revisit"
    right = whole | ((F.col("x.digest") == F.col("x.declared_digest")) & (F.col("stored") == F.col("x.declared_bytes")))
    size = F.when(right, F.col("x.declared_bytes")).otherwise(F.raise_error(F.lit("payload and digest differ")).cast("long"))
    return rows.select("x.page_id", size.alias("payload_bytes"), F.when(whole, F.col("x.declared_digest")).otherwise(F.col("x.digest")).alias("payload_digest"), "x.record_type", "x.refers_to")
