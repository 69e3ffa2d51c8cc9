"""WARC archives with revisit records.

Headers (id, digest, length) are shuffled by payload digest; of equal payloads of at least ``MIN_BYTES``
bytes the one with the largest id stays a response, the others become revisits that refer to it. Archives
are written by Spark's text sink, whose line separator is the blank line that ends a WARC record, gzipped,
with fresh headers; they are read back by content length, so a payload may hold anything.

Payloads travel once, by id, and hot digests only move headers: those are counted before the join, and AQE
splits what is left. Null html is the empty payload; null or repeated ids keep a record per row (repeated
rows of the largest id are all responses; a null id refers to the largest id of its group, and is a response
where the group has none); null urls give no target header; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprism.session import scratch_path

MIN_BYTES = 1000
RECORDS_PER_FILE = 20_000
READ_SCHEMA = (
    "page_id bigint, url string, record_type string, record_id string, refers_to_id string, declared_digest string, "
    "declared_bytes bigint, payload_digest string, payload_bytes bigint, payload binary"
)
CRLF = "\r\n"


def headers_of(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )


def choose_originals(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, payload_digest, payload_bytes, refers_to`` for every page that becomes a revisit."""
    key = ["payload_digest", "payload_bytes"]
    large = headers.where(F.col("payload_bytes") >= min_bytes).select("page_id", *key)
    groups = large.groupBy(*key).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    members = large.distinct().join(groups, key)
    return members.where(~F.col("page_id").eqNullSafe(F.col("refers_to")))


def _record_id(page_id, digest):
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def _line(name: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> None:
    """Write one record per page under ``path``; revisits hold no payload."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = headers_of(pages)
    revisits = choose_originals(headers, min_bytes).select(
        F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to"
    )
    # Matched on a key that is never null, so that null ids meet their revisit row too.
    key = lambda i, d: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("null")), d)
    rows = headers.withColumn("k", key(F.col("page_id"), F.col("payload_digest"))).join(
        revisits.select(key(F.col("r_id"), F.col("r_digest")).alias("k"), "refers_to"), "k", "left"
    )
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.when(revisit, _record_id(F.col("refers_to"), F.col("payload_digest")))
    head = F.concat(
        F.lit("WARC/1.0" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x1f]", " ")),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", refers),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block")),
        F.lit(CRLF),
    )
    text = rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    writer = text.write.option("lineSep", CRLF * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Reader:
    """Bytes of a gzip stream (one member or many), unpacked as they are asked for."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.ready = data, 0, bytearray()
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= len(self.data) and not self.unzip.unconsumed_tail:
            return False
        piece = self.unzip.unconsumed_tail or self.data[self.at : self.at + (1 << 18)]
        if not self.unzip.unconsumed_tail:
            self.at += len(piece)
        self.ready += self.unzip.decompress(piece, 1 << 22)
        if self.unzip.eof and (self.unzip.unused_data or self.at < len(self.data)):
            self.at -= len(self.unzip.unused_data)
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark))
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends inside a record header")
                return None
        out = bytes(self.ready[:i])
        del self.ready[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def parse_records(data: memoryview) -> Iterator[tuple]:
    """Rows of READ_SCHEMA for each record of a gzipped archive."""
    reader = _Reader(data)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = reader.take(int(fields["Content-Length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        page = fields.get("WARC-Page-ID")
        yield (
            None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields["WARC-Record-ID"],
            fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), declared,
            hashlib.sha1(payload).hexdigest(), len(payload), payload,
        )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path`` (READ_SCHEMA); digests and lengths are those of what was read."""
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                rows, size = [], 0
                for row in parse_records(memoryview(content.as_buffer())):
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1]) if payloads else 200
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the payload columns of the response they refer to filled in, and ``refers_to``.

    A revisit whose response is missing keeps its declared length and digest and has no ``refers_to``.
    """
    columns = ["payload_digest", "payload_bytes", "payload"]
    found = records.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to_id"))
    found = found.agg(F.first("page_id").alias("refers_to"), *(F.first(c).alias(f"_{c}") for c in columns))
    revisits = records.where(F.col("record_type") == "revisit").join(found, "refers_to_id", "left")
    filled = {"payload_digest": F.coalesce("_payload_digest", "declared_digest"), "payload_bytes": F.coalesce("_payload_bytes", "declared_bytes"), "payload": F.col("_payload")}
    revisits = revisits.withColumns(filled).select(*records.columns, "refers_to")
    rest = records.where(F.col("record_type") != "revisit").withColumn("refers_to", F.lit(None).cast("bigint"))
    return rest.unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives into the shared folder, read them back without payloads and resolve revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    return resolve_revisits(read_archives(spark, path, payloads=False))
