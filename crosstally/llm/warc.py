"""WARC archives through a chunked record table.

Payloads travel as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes. The writer turns a sorted run of chunks
into gzip members, one a record, and the reader turns archives back into chunks; both keep one chunk and a running
SHA-1 in memory, never a record. Equal payloads are stored once: the record with the largest page_id is the response,
the others revisit it. Which that is comes from digests and ids alone; payloads are cut where they are read and their chunks
shuffled once, by their row's number, so copies of one payload spread evenly and no shuffled row is longer than a chunk.

Files are written below the shared folder under names no other attempt uses; only those a finished task reports are read.
Files are opened with ``pyarrow.fs``, which knows local, HDFS, S3 and GCS addresses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, joined_evenly, new_folder, saved, small_batches

CHUNK = 1 << 16
FILE_BYTES = 64 << 20
# Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)  # stands for a null page_id where a key is needed


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page: int, row: int, sha1_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{row}/{sha1_hex}')}>"


def cut(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """row, key, url, sha1, size, chunk, last, data: the pages' payloads in chunks, cut where they are read and written at once."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("key"),
        F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    last = F.greatest(F.lit(0), F.floor((F.length("payload") - 1) / CHUNK)).cast("int")
    return scratch.saved(
        rows.select("row", "key", "url", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size"), "payload",
                    F.explode(F.sequence(F.lit(0), last)).alias("chunk"), last.alias("last"))
        .select("row", "key", "url", "sha1", "size", "chunk", "last",
                F.expr(f"substring(payload, chunk * {CHUNK} + 1, {CHUNK})").alias("data")), "zstd")


def planned(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Chunk rows with lead, lead_row and response, each record's in one partition and in order; a revisit has one row without
    bytes. The lead is the largest key of a payload; of rows that agree in key and payload the first is the response.

    What is decided by digest and id moves as narrow rows; chunks move once, dealt by their row's number.
    """
    pieces = cut(pages, scratch or Scratch(pages.sparkSession, "chunks"))
    rows = pieces.where("chunk = 0").select("row", "key", "sha1")
    leads = saved(
        rows.groupBy("sha1", "key").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .groupBy("sha1").agg(F.max("key").alias("lead"), F.max_by("first", "key").alias("lead_row"), F.sum("n").alias("rows")), "leads")
    facts = joined_evenly(rows.select("row", "sha1"), leads, "sha1", "rows").select("row", "lead", "lead_row")
    joined = pieces.join(facts, "row").withColumn("response", F.col("row") == F.col("lead_row"))
    kept = joined.where("response OR chunk = 0").withColumns(
        {"data": F.when(F.col("response"), F.col("data")).otherwise(F.lit(b"")),
         "last": F.when(F.col("response"), F.col("last")).otherwise(0)})
    return kept.sortWithinPartitions("row", "chunk")


def _head(row: dict, date: str) -> tuple[bytes, bytes]:
    """Header lines of the record, and the head of the response that starts its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if row['response'] else 'revisit'}",
             f"WARC-Record-ID: {record_id(row['key'], row['row'], row['sha1'])}", f"WARC-Date: {date}"]
    if row["url"]:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"]))
    if row["key"] != _NO_ID:
        lines.append(f"X-Page-Id: {row['key']}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest_text(bytes.fromhex(row['sha1']))}")
    if not row["response"]:
        lines += [f"WARC-Refers-To: {record_id(row['lead'], row['lead_row'], row['sha1'])}", f"WARC-Profile: {REVISIT}"]
    length = len(http) + (row["size"] if row["response"] else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass"), http


def written(plan: DataFrame, folder: str) -> DataFrame:
    """Write archives of planned records into ``folder``; path, records and bytes of each file, computed once."""
    spark = plan.sparkSession
    small_batches(spark)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out = path = packer = digest = None
        count = size = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]},
                                              schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["chunk"] == 0:
                    if out is not None and size >= FILE_BYTES:
                        yield closed()
                        out = None
                    if out is None:
                        path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(path, compression=None)
                    packer, digest = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1()
                    head, http = _head(row, date)
                    size += out.write(packer.compress(head + http)) or 0
                digest.update(row["data"])
                size += out.write(packer.compress(row["data"])) or 0
                if row["chunk"] == row["last"]:
                    if row["response"] and digest.hexdigest() != row["sha1"]:
                        raise ValueError(f"Chunks of page {row['key']} don't make up its payload")
                    size += out.write(packer.compress(b"\r\n\r\n") + packer.flush()) or 0
                    count += 1
        if out is not None:
            yield closed()

    return saved(plan.mapInArrow(run, "path string, records long, bytes long"), "archives")


class _Members:
    """Bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.plain, self.rest = stream, b"", b""
        self.unpacker = zlib.decompressobj(31)

    def fill(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.rest = self.unpacker.unused_data or self.rest
                self.unpacker = zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    return False
            more = self.unpacker.decompress(self.rest, CHUNK)
            self.rest = self.unpacker.unconsumed_tail
            if more:
                self.plain += more
                return True

    def line(self) -> bytes:
        while (end := self.plain.find(b"\n")) < 0:
            if not self.fill():
                end = len(self.plain) - 1
                break
        out, self.plain = self.plain[: end + 1], self.plain[end + 1 :]
        return out

    def some(self, most: int) -> bytes:
        if not self.plain and not self.fill():
            raise ValueError("An archive ends within a record")
        out, self.plain = self.plain[:most], self.plain[most:]
        return out


def _lines(stream: _Members) -> dict[str, str]:
    out = {}
    while (line := stream.line().strip()):
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        out[name.lower()] = value.strip()
    return out


def records(stream: _Members) -> Iterator[tuple[dict[str, str], int, bytes, int, str | None]]:
    """(headers, chunk number, bytes, payload bytes so far, digest on the last chunk) of an archive's records."""
    while line := stream.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"No record starts with {line[:20]!r}")
        headers = _lines(stream)
        left, head = int(headers["content-length"]), b""
        while not head.endswith(b"\r\n\r\n") and left:  # the response's own head
            piece = stream.line()
            head += piece
            left -= len(piece)
        digest, number, done = hashlib.sha1(), 0, 0
        while True:
            data = stream.some(min(left, CHUNK)) if left else b""
            left -= len(data)
            done += len(data)
            digest.update(data)
            yield headers, number, data, done, None if left else digest_text(digest.digest())
            number += 1
            if not left:
                break


_CHUNKS = ("record_id string, page_id long, record_type string, refers_to string, stated string, chunk int, data binary, "
           "payload_bytes long, payload_digest string")


def read(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives (path): a row a chunk, the digest on a record's last one.

    ``payload_bytes`` counts up to and with the chunk. ``with_data=False`` leaves the bytes out once they are digested.
    """
    spark = archives.sparkSession
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as file:
                    for h, number, data, done, digest in records(_Members(file)):
                        if not with_data and digest is None:
                            continue
                        page = h.get("x-page-id")
                        rows.append((h["warc-record-id"], int(page) if page else None, h["warc-type"], h.get("warc-refers-to"),
                                     h.get("warc-payload-digest", "").removeprefix("sha1:"), number, data if with_data else None,
                                     done, digest))
                        held += len(data) if with_data else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    paths = archives.select("path")
    return paths.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, _CHUNKS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, as read back from its archives.

    Null and empty html are an empty payload. A null page_id keeps its row and counts as the smallest id, its
    revisits refer to null. Rows equal in id and payload are records of their own, one of them the response if
    theirs is the largest id. Extra columns are ignored; an empty table gives no rows and no file.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    scratch = Scratch(spark, "chunks")
    archives = written(planned(pages, scratch), folder)
    scratch.remove()  # the archives have it all
    last = saved(read(archives, folder, with_data=False).where("payload_digest IS NOT NULL"), "records")
    responses = last.where("record_type = 'response'")
    if not responses.where("payload_digest <> stated").isEmpty():
        raise ValueError("An archived payload doesn't have the digest its record states")
    found = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response_page"),
                             F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("long").alias("refers_to")).unionByName(
        last.where("record_type = 'revisit'").join(found, "refers_to", "left").select(
            "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
            F.col("response_page").alias("refers_to")))
