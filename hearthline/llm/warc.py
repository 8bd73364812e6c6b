"""WARC archives of pages (operator 4).

Pages become a stored table of chunks: a row for each (record, chunk number)
with at most ``chunk`` bytes of the payload. Which payloads occur more than once is found from ids and digests
alone and joined to the chunks by record number. The writer gets the chunks of a record
one after the other, carries the digest over them and writes a payload of more than one chunk as WARC segments, one record for
each chunk, so beside the cell of the input no whole payload is held, neither in writing nor in reading. Spark's text writer stores the records below a folder, as gzip
files whose lines are the bytes between line feeds; a line feed ends each record, after the
carriage return and the empty line that WARC asks for. The reader goes through
each file in order, keeps the state of one record, and updates the
digest chunk by chunk.

Payloads that occur more than once are stored once: the record of the smallest
``page_id`` is the response, the others are revisits that name it. Equal means equal
SHA-1 and length.

* null payload: an empty one
* null ``page_id``: a response of its own
* pages with equal id and payload are all responses (ties for the smallest id)
* empty table: an empty archive
* columns beyond id, address and payload are not archived, whatever their names
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, shuffle_files_removed, stored

CHUNK = 1 << 20
SALTS = 16
END = b"\r\n"
PARSED = "record_id string, page_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_table(pages: DataFrame, chunk: int = CHUNK, id_column: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """``row`` (a number of the record), ``chunk`` (from 0), ``data``, and with the first chunk ``page_id, url, digest, bytes``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("bytes", F.length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    # numbers are multiplied, not payloads: each row cuts its own piece
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("bytes") / chunk) - 1, F.lit(0)).cast("bigint"))).alias("chunk"))
    at = (F.col("chunk") * chunk + 1).cast("int")
    own = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)
    return stored(each.select("row", "chunk", own("page_id"), own("url"), own("digest"), own("bytes"), F.substring("payload", at, F.lit(chunk)).alias("data")), "op4-chunks")


def find_revisits(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``row, refers_to`` of the records whose payload a page with a smaller id has. Only ids and digests are shuffled."""
    ids = chunks.where(F.col("chunk") == 0).where(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes)).select("row", "page_id", "digest", "bytes")
    first = ids.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a payload may belong to a third of all pages: its few columns are spread over salts
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return ids.join(first, ["digest", "bytes", "salt"]).where("page_id > refers_to").select(F.col("row").alias("of"), F.col("refers_to").cast("string"))


def record_writer(chunk: int):
    """Chunks in order of (row, chunk) -> one string for each WARC record, without its last line feed. A task has all chunks of its records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])

        def batch_of(rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], schema=schema)

        held, size = [], 0
        name, head, digest, done, total, pieces, wanted = "", [], hashlib.sha1(), 0, 0, 1, ""
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "chunk", "page_id", "url", "refers_to", "digest", "bytes")]
            for row, k, page, url, refers_to, sha1, n, cell in zip(*columns, batch.column("data")):
                part = cell.as_buffer() if cell.is_valid else b""
                if not k:
                    name, digest, done, total, wanted = f"<urn:hearthline:page:{row}>", hashlib.sha1(), 0, n, sha1
                    pieces = 1 if refers_to is not None else max(1, -(-n // chunk))
                    head = [
                        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "about:blank").split()) or "about:blank"),
                        ("WARC-Payload-Digest", "sha1:" + base32_digest(bytes.fromhex(sha1))), ("Page-Bytes", n),
                    ]
                    if page is not None:
                        head.append(("Page-Id", page))
                digest.update(part)
                done += len(part)
                if k == pieces - 1 and refers_to is None and (done, digest.hexdigest()) != (total, wanted):
                    raise ValueError(f"chunks of {name} do not make up its payload")
                lines = [("WARC-Record-ID", name if not k else f"{name[:-1]}:{k + 1}>")]
                if k:
                    lines += [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", name)]
                elif refers_to is not None:
                    lines += [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page", refers_to)]
                else:
                    lines += [("WARC-Type", "response"), ("Content-Type", "text/html; charset=utf-8")]
                if pieces > 1:
                    lines.append(("WARC-Segment-Number", k + 1))
                    if k == pieces - 1:
                        lines.append(("WARC-Segment-Total-Length", total))
                lines += (head if not k else head[:2]) + [("Content-Length", len(part))]
                text = "WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in lines) + "\r\n"
                held.append(b"".join((text.encode(), part, b"\r\n\r")))  # the text writer adds the last line feed
                size += len(part)
                if size >= chunk:
                    yield batch_of(held)
                    held, size = [], 0
        yield batch_of(held)

    return write


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, chunk: int = CHUNK, id_column: str = "page_id", payload: str = "html", url: str = "url") -> None:
    """Write a WARC record (or its segments) for each row of ``pages`` below ``path``."""
    chunks = chunk_table(pages, chunk, id_column, payload, url)
    # dealt by record number, which the join keeps: a task has all chunks of its records
    rows = chunks.repartition("row").join(find_revisits(chunks, least_bytes), F.col("row") == F.col("of"), "left").where("refers_to IS NULL OR chunk = 0")
    rows = rows.select("row", "chunk", F.col("page_id").cast("string"), "url", "refers_to", "digest", "bytes", F.when(F.col("refers_to").isNull(), F.col("data")).alias("data"))
    # bytes pass through the text writer as they are
    records = rows.sortWithinPartitions("row", "chunk").mapInArrow(record_writer(chunk), "value binary").select(F.col("value").cast("string").alias("value"))
    with shuffle_files_removed(pages.sparkSession):
        records.write.option("compression", "gzip").option("lineSep", "\n").text(path)
    discard(chunks)


class RecordReader:
    """Takes an archive's bytes piece by piece; ``take`` yields (headers, chunk number, bytes or None at the end of the record)."""

    def __init__(self):
        self.head: bytearray | None = bytearray()
        self.headers: dict[str, str] = {}
        self.left = self.gap = 0

    def take(self, data: bytes):
        view, at = memoryview(data), 0
        while at < len(view):
            if self.gap:  # the two line ends after a record
                step = min(self.gap, len(view) - at)
                self.gap -= step
                at += step
            elif self.head is not None:
                stop = data.find(b"\n", at) + 1 or len(view)
                self.head += view[at:stop]
                at = stop
                if self.head.endswith(b"\r\n\r\n"):
                    lines = bytes(self.head).decode("utf-8", "replace").split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                    self.headers = dict(line.split(": ", 1) for line in lines[1:] if line)
                    self.head, self.left = None, int(self.headers["Content-Length"])
                    if not self.left:
                        yield from self._close()
            else:
                step = min(self.left, len(view) - at)
                yield self.headers, bytes(view[at : at + step])
                self.left -= step
                at += step
                if not self.left:
                    yield from self._close()

    def _close(self):
        yield self.headers, None
        self.head, self.gap = bytearray(), 4


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes | None]]:
    reader, path = RecordReader(), None
    for batch in batches:
        for file, line in zip(batch.column("file").to_pylist(), batch.column("value")):
            if file != path:
                reader, path = RecordReader(), file
            yield from reader.take((line.as_buffer().to_pybytes() if line.is_valid else b"") + b"\n")


def record_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each page from the records of whole files, digests taken from what is stored."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    out: list[tuple] = []
    origin, digest, size = None, hashlib.sha1(), 0

    def line() -> tuple:
        kind, stored_digest, stored_size = origin["WARC-Type"], origin["WARC-Payload-Digest"].removeprefix("sha1:"), int(origin["Page-Bytes"])
        if kind == "response" and (base32_digest(digest.digest()), size) != (stored_digest, stored_size):
            raise ValueError(f"payload of {origin['WARC-Record-ID']} does not agree with its digest")
        return origin["WARC-Record-ID"], origin.get("Page-Id"), kind, origin.get("Refers-To-Page"), stored_digest, stored_size

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n != "payload_bytes" else pa.int64()) for n, c in zip(names, columns)], names=names)

    for headers, data in read_chunks(batches):
        if headers["WARC-Type"] != "continuation" and headers is not origin:
            if origin is not None:
                out.append(line())
            origin, digest, size = headers, hashlib.sha1(), 0
        if data is not None:
            digest.update(data)
            size += len(data)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if origin is not None:
        out.append(line())
    yield batch_of(out)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk table of the stored payloads: record, chunk number, bytes."""
    record, number, held = None, 0, []
    for headers, data in read_chunks(batches):
        own = headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"])
        if own != record:
            record, number = own, 0
        if data:
            held.append((own, number, data))
            number += 1
        if sum(len(h[2]) for h in held[-1:]) > 1 << 16 or len(held) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.binary()))], names=["record_id", "chunk", "data"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.binary()))], names=["record_id", "chunk", "data"])


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the archive files with their file; a gzip file is read by one task, in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page of an archive; fails if a payload is not what its digest says."""
    return archive_lines(spark, path).mapInArrow(record_digests, PARSED)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, chunk, data``: the stored payloads in pieces, to be put together in order of ``chunk``."""
    return archive_lines(spark, path).mapInArrow(chunk_rows, "record_id string, chunk bigint, data binary")
