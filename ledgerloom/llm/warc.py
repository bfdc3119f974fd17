"""WARC archives written from, and read back as, a table of payload chunks.

Payloads travel as rows of (record, chunk number, bytes), so that no step needs
memory for a whole record: the writer compresses chunk after chunk into a gzip member per
record, the reader decompresses and yields chunk rows that carry the SHA-1 and the byte
count of the payload up to there. Of records with equal payloads one is the response, the
others are revisit records that name it and repeat its digest without the payload.

Each task writes one archive, named after its partition and attempt, in the given shared
folder; only archives named in the returned rows belong to the result, so a task that was
retried leaves nothing behind that is read.

Defined results: null payload counts as empty; empty payloads are payloads like others;
the largest page_id of equal payloads is the response, all rows with that id if they are
repeated; with only null ids every row is a response; a null url is written as the
record's own name; records that share page and payload are numbered, so that identifiers are
unique; a payload that differs from its digest, or a revisit without its response, is an error;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, shared_dir, table

CHUNK = 65_536
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def chunked(pages: DataFrame, least_bytes: int = LEAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """A row per payload chunk, with the record's type decided; revisit records have one empty chunk."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body")).withColumn("sha1", F.sha1("body")).withColumn("bytes", F.octet_length("body").cast("long"))
    rows = rows.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    names = rows.select("key", "page_id", "sha1", "bytes")
    first = names.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    # decided on names alone, so that the copies of a common page do not meet with their bodies
    revisits = names.join(first.hint("merge"), ["sha1", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select("key", "sha1", "bytes", "first").distinct()
    told = rows.join(revisits.hint("merge"), ["key", "sha1", "bytes"], "left").withColumn("revisit", F.col("first").isNotNull())
    told = told.withColumn("copy", F.row_number().over(Window.partitionBy("key", "sha1", "bytes").orderBy("url")))
    n = F.when(F.col("revisit"), 0).otherwise(F.greatest(F.ceil(F.col("bytes") / chunk).cast("int") - 1, F.lit(0)))
    part = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return told.withColumn("last_no", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), "last_no"))).select("page_id", "url", "sha1", "bytes", "revisit", "first", "chunk_no", "last_no", part.alias("part"), "copy")


def _name(page_id, sha1: str, copy: int) -> str:
    """A record's identifier: rows that share a page_id differ in the payload's digest or are numbered."""
    return f"urn:page:{'' if page_id is None else page_id}:{sha1}:{copy}"


def _head(page_id, url, sha1, size, revisit, first, copy) -> bytes:
    name = _name(page_id, sha1, copy)
    uri = quote(url, safe="/:?#[]@!$&'()*+,;=%~-._") if url else name
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32(sha1)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{_name(first, sha1, 1)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + (0 if revisit else size)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; (path, records, bytes) for each. Rows of a record must be adjacent and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, records, size, gz = None, 0, 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), batch.column(8), batch.column(9).to_pylist(), strict=True):
                page_id, url, sha1, n, revisit, first, chunk_no, last_no, part, copy = row
                if out is None:
                    fs, path = _open_fs(uri)
                    out = fs.open_output_stream(path, compression=None)
                if chunk_no == 0:
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(gz.compress(_head(page_id, url, sha1, n, revisit, first, copy) + HTTP))
                    records += 1
                out.write(gz.compress(part.as_buffer()))
                if chunk_no == last_no:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return chunks.mapInArrow(run, "path string, records long, bytes long")


class Records:
    """The records of a .warc.gz stream; payloads come chunk by chunk."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.buffer, self.raw, self.gz, self.end = stream, chunk, b"", b"", zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.end:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            data = self.raw or self.stream.read(self.chunk)
            if not data:
                self.end = True
                return False
            got = self.gz.decompress(data, 4 * self.chunk)
            self.raw = self.gz.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a header")
                return None
        head, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            got, self.buffer = self.buffer[: min(n, self.chunk)], self.buffer[min(n, self.chunk) :]
            n -= len(got)
            yield got

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while (head := self.until(b"\r\n\r\n")) is not None:
            fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
            http = self.until(b"\r\n\r\n")
            yield fields, self.take(int(fields["Content-Length"]) - len(http) - 4)
            if b"".join(self.take(4)) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row per payload chunk of the archives named in column path, in order within an archive.

    digest and bytes cover the payload so far; last marks a record's final chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "claimed", "chunk_no", "part", "bytes", "digest", "last"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        page = lambda s: int(x) if s and (x := s.strip("<>").removeprefix("urn:page:").split(":")[0]) else None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _open_fs(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, parts in Records(stream):
                        head = (page(fields["WARC-Record-ID"]), fields["WARC-Type"], page(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        sha1, size, number, held = hashlib.sha1(), 0, 0, None
                        for part in parts:
                            if held is not None:
                                if payload:
                                    rows.append((*head, number, held, size, base64.b32encode(sha1.digest()).decode(), False))
                                number += 1
                            held = part
                            sha1.update(part)
                            size += len(part)
                            if len(rows) >= 256:
                                yield out()
                        rows.append((*head, number, (held or b"") if payload else b"", size, base64.b32encode(sha1.digest()).decode(), True))
                        if len(rows) >= (256 if payload else 10_000):
                            yield out()
        yield out()

    return archives.select("path").mapInArrow(run, "page_id long, record_type string, refers_to long, claimed string, chunk_no long, part binary, bytes long, digest string, last boolean")


def _sure(holds: Column, what: str) -> Column:
    """A filter that keeps every row and fails on one for which the condition does not hold."""
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}, page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")))).cast("boolean"))


def records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the last chunk of each record.

    A payload that differs from its digest, and a revisit whose response is not there, are errors.
    """
    ends = chunks.where("last").select("page_id", "record_type", "refers_to", "claimed", "bytes", "digest")
    whole = ends.where("record_type = 'response'").where(_sure(F.col("digest") == F.col("claimed"), "payload differs from its digest"))
    full = whole.where("page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("claimed"), "bytes").distinct()
    seen = ends.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "claimed").join(full.hint("merge"), ["refers_to", "claimed"], "left")
    seen = seen.where(_sure(F.col("bytes").isNotNull(), "revisit of a response that is not there"))
    return whole.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to").unionByName(seen.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("claimed").alias("payload_digest"), "record_type", "refers_to"))


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, path = _open_fs(folder)
    fs.create_dir(path)
    archives = cut(write(chunked(table(spark, sf_dir, "pages")), folder))
    back = cut(records(read(archives.repartition(max(1, archives.count())), payload=False)))
    fs.delete_dir(path)
    return back


_HEX = "sha1(encode(coalesce(html, '')))"
SQL_OP10 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {_HEX} AS h FROM pages),
b AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * i, 5))::INT >> (15 - 5 * j)::INT) % 32, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
  max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""
