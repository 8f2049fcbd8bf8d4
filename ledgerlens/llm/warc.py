"""WARC archives: records from rows, revisit records for repeated payloads, and reading back.

Payloads that occur more than once are stored once. Headers (id, URL, digest) are shuffled
by payload digest; the smallest id of a digest stays a response, the others become revisit
records that refer to it. A payload travels once per digest, whatever the number of its
copies.

An archive is a run of records, each a gzip member of its own, as WARC files usually are.
Tasks build archives of a bounded size as rows, and Spark's text writer stores one row per
file with its commit protocol, so archives can lie in any store that Spark writes. An
archive ends with an empty gzip member; its last byte, a zero, is the writer's line end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column, skewed_join

#: shorter payloads are never replaced by a revisit record, in bytes
LEAST_PAYLOAD = 100
#: an archive is closed when its compressed records reach this many bytes
ARCHIVE_BYTES = 4_000_000
#: compressed bytes that a reader inflates at once
PIECE = 1 << 14

#: Names and values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
END = b"\r\n\r\n"
#: Extension field with the id of the row that a record was made of.
SOURCE_FIELD = "X-Source-Id"

UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORDS = (
    "record_id string, source_id string, record_type string, url string, date string, "
    "payload_digest string, refers_to string, payload binary"
)


def compressor():
    return zlib.compressobj(6, zlib.DEFLATED, 31)


def member(data: bytes) -> bytes:
    packer = compressor()
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = member(b"")


def header(fields: list[tuple[str, str | None]]) -> bytes:
    """Named fields of a record; a null has no line, and no value can break its line."""
    lines = [f"{name}: {UNSAFE.sub(escaped, value)}" for name, value in fields if value is not None]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END


def escaped(found: re.Match) -> str:
    return f"%{ord(found.group()):02X}"


def record(row: dict, date: str) -> bytes:
    """One record: WARC header, block (HTTP header, payload if it is a response), two line ends."""
    revisit = row["refers_to"] is not None
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (b"" if revisit else row["payload"] or b"")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", "sha256:" + row["payload_digest"]),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", row["refers_url"]),
        (SOURCE_FIELD, row["source_id"]),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    return header(fields) + block + END


def archives(date: str, size: int):
    """Rows of records → rows of whole archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            # the writer's line end is the last byte
            whole = b"".join(parts) + EMPTY_MEMBER[:-1]
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["archive"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                parts.append(member(record(row, date)))
                held += len(parts[-1])
                if held >= size:
                    yield closed()
                    parts.clear()
                    held = 0
        if parts:
            yield closed()

    return run


def record_id(*parts: Column) -> Column:
    """URN in UUID form from the digest of what makes a record unique."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, *c) for c in cuts)), F.lit(">"))


def resolve(df: DataFrame, key: str, url: str, payload: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Records to write, one per row: responses with their payload, revisits without.

    Rows of equal payloads of ``least`` bytes or more form a group; the row of the
    smallest id is its response (null ids last; of repeated ids any one), all others
    refer to it. Shorter payloads are responses each. A null payload is empty.
    """
    text = F.coalesce(column(payload).cast("binary"), F.lit(b""))
    pages = df.select(
        column(key).alias("key"), column(url).cast("string").alias("url"), text.alias("payload"),
        F.octet_length(text).cast("long").alias("payload_bytes"), F.sha2(text, 256).alias("payload_digest"),
    )
    slim = ["record_id", "source_id", "url", "payload_bytes", "payload_digest"]
    none = F.lit(None).cast("string")
    source = F.col("key").cast("string").alias("source_id")
    small = pages.where(F.col("payload_bytes") < least).withColumn("_n", F.monotonically_increasing_id())
    small = small.withColumn("record_id", record_id(F.lit("small"), F.col("key"), F.col("_n")))
    small = small.select("record_id", source, *slim[2:], none.alias("refers_to"), none.alias("refers_url"), "payload")

    large = pages.where(F.col("payload_bytes") >= least)
    headers = large.drop("payload").withColumn("_n", F.monotonically_increasing_id())
    headers = pin(headers.withColumn("record_id", record_id(F.lit("large"), F.col("key"), F.col("_n"))))
    rank = F.struct(F.col("key").isNull(), "key", "_n", "record_id", "url")
    first = headers.groupBy("payload_digest").agg(F.min(rank).alias("_first"))
    first = pin(first.select("payload_digest", "_first.*").drop("col1"))

    bodies = large.groupBy("payload_digest").agg(
        F.first("payload").alias("payload"), F.first("payload_bytes").alias("payload_bytes")
    )
    responses = first.join(bodies, "payload_digest").select(
        "record_id", source, *slim[2:], none.alias("refers_to"), none.alias("refers_url"), "payload"
    )
    origin = first.select(
        "payload_digest", F.col("record_id").alias("refers_to"), F.col("url").alias("refers_url")
    )
    revisits = skewed_join(headers, origin, ["payload_digest"], "inner").where("record_id != refers_to")
    revisits = revisits.select(
        "record_id", source, *slim[2:], "refers_to", "refers_url", F.lit(None).cast("binary").alias("payload")
    )
    return small.union(responses).union(revisits)


def write(
    df: DataFrame, path: str, key: str, url: str, payload: str,
    least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record per row to archives under ``path``, repeated payloads as revisits.

    Every row has a record, repeated rows too; an empty table leaves a folder without
    records. Null URLs and ids have no header field; white space and control characters
    of a URL are percent-encoded, so no value can forge a header. Payloads of any content
    and length are kept byte by byte: readers go by lengths, not by marks in the text.
    Other columns of ``df`` are not read. An archive is at most ``archive_bytes`` and one
    record long.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolve(df, key, url, payload, least).mapInArrow(archives(date, archive_bytes), "archive binary")
    out = rows.select(F.col("archive").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(archive: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of an archive, one at a time.

    The archive is inflated piece by piece, so that what follows a member is never
    copied as a whole.
    """
    view, at = memoryview(archive), 0
    while at < len(view):
        reader, out = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            out.append(reader.decompress(view[at : at + PIECE]))
            at += min(PIECE, len(view) - at)
        at -= len(reader.unused_data)
        if data := b"".join(out):
            yield data


def parsed(data: bytes) -> dict:
    """Fields and payload of one record; its block is cut by Content-Length."""
    head, _, rest = data.partition(END)
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {}
    for line in lines:
        name, _, value = line.partition(b":")
        fields[name.decode().strip().lower()] = value.strip(b" \t").decode()
    block = rest[: int(fields["content-length"])]
    payload = None
    if fields["warc-type"] == "response":
        payload = block.partition(END)[2]
    return {
        "record_id": fields["warc-record-id"],
        "source_id": fields.get(SOURCE_FIELD.lower()),
        "record_type": fields["warc-type"],
        "url": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to": fields.get("warc-refers-to"),
        "payload": payload,
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under a path, a row each; revisits have no payload.

    An archive is one row of a task, hence the bound on its size when it is written.
    """
    names = [part.split()[0] for part in RECORDS.split(",")]
    types = [pa.binary() if n == "payload" else pa.string() for n in names]
    arrow = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for data in members(batch.column("content")[k].as_py()):
                    rows.append(parsed(data))
                    held += len(data)
                    if held >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the size and digest of their full payload and the id of their origin.

    Columns source_id, payload_bytes, payload_digest, record_type, refers_to (source id of
    the response that a revisit refers to). Sizes and digests are those of the payloads
    that were read, for a revisit of its response's payload.
    """
    slim = records.select(
        "record_id", "source_id", "record_type", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    slim = pin(slim)
    origin = slim.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("source_id").alias("_origin"),
        "payload_bytes", "payload_digest",
    )
    revisits = slim.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    found = skewed_join(revisits, origin, ["refers_to"], "left")
    columns = ["source_id", "payload_bytes", "payload_digest", "record_type"]
    responses = slim.where("record_type = 'response'")
    return responses.select(*columns, F.lit(None).cast("string").alias("refers_to")).union(
        found.select(*columns, F.col("_origin").alias("refers_to"))
    )
