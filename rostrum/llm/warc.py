"""WARC archives compressed with a shared Zstandard dictionary.

A dictionary is trained on a sample of the records. Each archive opens with it
in a skippable frame, then comes a warcinfo record, and every record is a frame
of its own, so that a record can be read alone. An archive ends before it grows
beyond ``archive_bytes``, so that readers hold that much; a longer record has an
archive of its own. Archives are written by Spark's own text sink: an archive is
the one line of its file, and the line separator is an empty skippable frame,
which readers pass over. So the sink's commit protocol, any file system that
Spark reaches and lost executors are its business, and no record passes the driver.

Of records with equal payloads the one with the largest page_id is a response
and the others are revisits that refer to it; smaller payloads than
``min_bytes`` are all responses. A revisit keeps the HTTP header of its response,
and so the payload's length, but not the payload. Payloads are compared by
SHA-1. Several rows with the largest page_id and equal payloads are all
responses, and so are rows without an id whose payload no row with an id has.
A record's id is made of the page's and the payload's digest, so that only rows
equal in both share one.

Null payloads are empty. Null or odd URLs are percent-encoded. An empty table
gives no records. Very long pages are records like others, held whole by the
task that writes or reads them. Columns besides page_id, url and html aren't
stored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import checkpointed, shared_folder, small

#: Fixed values of the formats: frame magics, and the separator as text.
DICTIONARY_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = "P*M\u0018\u0000\u0000\u0000\u0000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Repeated payloads (40 bytes a row) up to which their table is broadcast, so that pages stay where they are; beyond, a shuffle joins it.
BROADCAST_PAYLOADS = 1_000_000
#: Records that the dictionary is trained on at most, characters of each, and its size in bytes.
SAMPLE, SAMPLE_WIDTH, DICTIONARY_SIZE, LEVEL = 400, 32_768, 16_384, 6
#: Compressed bytes of an archive.
ARCHIVE_BYTES = 64 << 20


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _name(page_id: int | None, sha1: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{_base32(sha1)}>"


def record(page_id: int | None, url: str | None, html: str | None, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP header."""
    body = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + (b"" if revisit else body)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, sha1)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{_base32(sha1)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to, sha1)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info() -> bytes:
    """The warcinfo record that an archive opens with."""
    block = b"software: rostrum\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few records, their own bytes as a raw one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_SIZE]


def _dictionary_of(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds sha1, refers_to and revisit. Only digests and ids are aggregated; the join's keys may be hot, and are split then."""
    html = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.withColumn("sha1", F.sha1(html.cast("binary"))).withColumn("long_enough", F.octet_length(html) >= min_bytes)
    last = hashed.filter("long_enough").groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha1", "last")
    joined = hashed.join(small(checkpointed(last), BROADCAST_PAYLOADS), "sha1", "left")
    revisit = F.coalesce(F.col("long_enough") & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.lit(False))
    return joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("last"))).drop("long_enough", "last")


def _line(frames: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b"".join(frames)], pa.binary())], names=["value"])


def write(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes pages (page_id, url, html) as archives under ``folder``, each partition one or more; returns the folder."""
    import zstandard

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # hashes are picked first, so that no partition sends a sample's worth of pages to the driver; of a long page, a piece from anywhere in it
    key = F.xxhash64("page_id", "html")
    picked = [r[0] for r in rows.select(key.alias("h")).orderBy("h").limit(SAMPLE).collect()]
    html = F.coalesce("html", F.lit(""))
    start = F.lit(1) + F.pmod(key, F.greatest(F.char_length(html) - SAMPLE_WIDTH, F.lit(0)) + 1).cast("int")
    sample = sorted(rows.filter(key.isin(picked)).limit(SAMPLE).select("page_id", "url", F.substring(html, start, F.lit(SAMPLE_WIDTH)).alias("html")).collect(), key=str)
    trained = _dictionary([record(r.page_id, r.url, r.html, hashlib.sha1((r.html or "").encode()).hexdigest(), None, False) for r in sample])

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary_of(trained))
        opening = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
        frames, size = [opening + packer.compress(info())], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    frame = packer.compress(record(r["page_id"], r["url"], r["html"], r["sha1"], r["refers_to"], r["revisit"]))
                    if size and size + len(frame) > archive_bytes:
                        yield _line(frames)
                        frames, size = [opening + packer.compress(info())], 0
                    frames.append(frame)
                    size += len(frame)
        if size:
            yield _line(frames)

    known = with_revisits(rows, min_bytes).select("page_id", "url", "html", "sha1", "refers_to", "revisit")
    known.mapInArrow(archive, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(folder)
    return folder


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its header and its blocks' headers."""
    mark = data[at + 4]
    single, checksum = mark >> 5 & 1, mark >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[mark & 3] + (single, 2, 4, 8)[mark >> 6]
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checksum


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed on its own with the dictionary that leads it."""
    import zstandard

    reader, at = zstandard.ZstdDecompressor(), 0
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_MAGIC:
            reader = zstandard.ZstdDecompressor(dict_data=_dictionary_of(data[at + 8 : at + 8 + size]))
            at += 8 + size
        elif magic & 0xFFFFFFF0 == SKIP_MAGIC:
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield reader.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")


def parse(raw: bytes) -> dict:
    """A record's headers and payload; a response's digest is that of its payload, a revisit's is the one it states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if name is None or name.startswith("<urn:page:none:") else int(name[10:-1].split(":")[0])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload": None if revisit else payload,
        "payload_bytes": int(_LENGTH.search(http)[1]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_KINDS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a folder; payload is null for revisits, or for all if not asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0

                def flushed(held: list[dict]) -> pa.RecordBatch:
                    return pa.record_batch([pa.array([r[k] for r in held], t) for k, t in _KINDS.items()], names=list(_KINDS))

                for raw in records(content.as_py()):
                    if raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"):
                        continue
                    held.append(parse(raw) if payloads else parse(raw) | {"payload": None})
                    size += len(raw) * payloads
                    if len(held) >= 5_000 or size > 4_000_000:
                        yield flushed(held)
                        held, size = [], 0
                if held:
                    yield flushed(held)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, SCHEMA)


#: DuckDB's rows of op8_warc: five hexadecimal digits of a SHA-1 make four digits of base 32.
OP8_SQL = """WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY hex) AS last FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM d"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, payloads=False).drop("url", "payload")
