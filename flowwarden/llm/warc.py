"""WARC archives written from and read back as chunked record tables.

A record is rows of record id and chunk number, so no task holds a whole payload. The writer
streams chunks into the archive; the reader streams them out, each with the number of bytes
and the SHA-256 of the payload up to its end, and the last chunk's are those of the record.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import reader, scratch_path, stored, writer

CHUNK = 1 << 18
#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 100
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to of every row. Of rows with equal
    payloads of at least ``least`` bytes that with the smallest page_id is written, the others
    refer to it (repeats of that very row are written too). A null html is empty."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    copies = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(copies.where("n > 1").drop("n"), "digest", "left").select(
        "page_id", "url", "payload", "n_bytes", "digest", first.alias("refers_to")
    )


def chunked(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows of chunk_no and data; a revisit has one empty chunk."""
    last = F.when(F.col("refers_to").isNull(), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / chunk)).otherwise(0)
    rows = found.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    data = F.when(
        F.col("refers_to").isNull(), F.substring("payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))
    ).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "n_bytes", "digest", "refers_to", "chunk_no", data.alias("data"))


def _name(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}:{digest}')}>"


def _header(page, url, n_bytes, digest, refers_to) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(_HTTP) + (n_bytes if refers_to is None else 0)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Streams the chunks of each partition, which follow each other, into one
    compressed archive. Returns the archives: path and number of records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n = f"{folder}/pages-{TaskContext.get().partitionId():07d}.warc.gz", 0
        with writer(path, "gzip") as out:
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(6)]
                for i, row in enumerate(zip(*columns, strict=True)):
                    if row[5] == 0:
                        out.write((b"\r\n\r\n" if n else b"") + _header(*row[:5]) + _HTTP)
                        n += 1
                    out.write(batch.column(6)[i].as_buffer())
            out.write(b"\r\n\r\n" if n else b"")
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])

    return stored(rows.mapInArrow(work, "path string, n long"), "archives").where("n > 0")


class _Lines:
    """Buffered reads of header lines and of bytes from a stream."""

    def __init__(self, stream):
        self._stream, self._held = stream, b""

    def line(self) -> bytes | None:
        while b"\r\n" not in self._held:
            more = self._stream.read(1 << 16)
            if not more:
                return None
            self._held += more
        found, self._held = self._held.split(b"\r\n", 1)
        return found

    def take(self, n: int) -> bytes:
        if not self._held:
            self._held = self._stream.read(max(n, 1 << 16))
        found, self._held = self._held[:n], self._held[n:]
        if not found and n:
            raise ValueError("the archive ends inside a record")
        return found


def archive_chunks(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunks of all records of an archive, one at a time."""
    lines = _Lines(stream)
    while (line := lines.line()) is not None:
        if not line:
            continue
        fields = {}
        while line := lines.line():
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        left = int(fields["Content-Length"])
        while line := lines.line():
            left -= len(line) + 2
        left -= 2
        record = {
            "record_id": fields["WARC-Record-ID"],
            "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "refers_id": fields.get("WARC-Refers-To"),
        }
        digest, n_bytes, number = hashlib.sha256(), 0, 0
        while True:
            wanted, parts = min(left, chunk), []
            while wanted:
                parts.append(lines.take(wanted))
                wanted -= len(parts[-1])
            data = b"".join(parts)
            digest.update(data)
            left, n_bytes = left - len(data), n_bytes + len(data)
            yield record | {
                "chunk_no": number, "last": left == 0, "bytes_so_far": n_bytes,
                "digest_so_far": digest.copy().hexdigest(), "data": data,
            }
            number += 1
            if not left:
                break


def read(archives: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives; without ``payloads`` data is left empty."""
    schema = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_id", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("data", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with reader(path, "gzip") as stream:
                    for row in archive_chunks(stream, chunk):
                        if not payloads:
                            row["data"] = None
                        held.append(row)
                        size += len(row["data"] or b"") + 512
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    kinds = (
        "record_id string, page_id long, url string, record_type string, refers_id string, chunk_no long, "
        "last boolean, bytes_so_far long, digest_so_far string, data binary"
    )
    files = archives.count()  # an explicit number: else small lists of paths end up in one task
    return archives.select("path").repartitionByRange(max(files, 1), "path").mapInArrow(work, kinds)


def resolved(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record: revisits
    take length and digest from the response that they name."""
    whole = stored(chunks.where("last").drop("data", "chunk_no", "last", "url"), "records")
    answers = whole.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(
        F.max("bytes_so_far").alias("bytes"), F.max("digest_so_far").alias("digest"), F.max("page_id").alias("refers_to")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # only revisits are joined: responses have no reference, one null key for most rows
    revisits = whole.where("record_type = 'revisit'").join(answers, "refers_id", "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
    others = whole.where("record_type != 'revisit'").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    return others.unionByName(revisits).select(columns)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return resolved(read(write(chunked(records(pages)), folder), payloads=False))
