"""Operator 9, WARC archives: written with segmented, chunk-coded records, read back by segment reassembly.

Writing: every row becomes one record whose HTTP body is chunk-coded; a block
longer than ``segment_bytes`` is cut into a first record and continuation
records (``WARC-Segment-Number``, ``WARC-Segment-Origin-ID``, and the total
length on the last).  Of rows with equal payloads of at least ``least_bytes``
bytes the one with the largest id is the response, the others are revisit
records without a payload that refer to it.  The archives are Spark's own
gzipped text files: a record is a value, the line separator is the blank line
that ends a record.

Reading: archives are parsed by ``Content-Length``; continuation records are
grouped by their origin, ordered by segment number and joined, the sum of the
pieces is checked against the total length, and the chunked framing is decoded.
Whole records need no shuffle.

Defined results: null and empty payloads are zero bytes long; a null url has no
header and reads back null; line breaks in a url are percent-coded.  Rows without
id can refer but aren't referred to; where no row of equal payloads has an id all
are responses.  Repeated rows each get a record; repeats of the largest id are all
responses.  A record whose pieces are missing or too short reads back with
``complete`` false and no payload.  Extra columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
BREAK = b"\r\n"
CHUNK = 8192
RECORDS = ("record_id string, record_type string, url string, digest string, refers_to string, "
           "segment int, origin string, total long, block binary")
RESULT = ("record_id string, record_type string, url string, refers_to string, payload binary, "
          "payload_bytes long, payload_digest string, complete boolean")
OUT_BYTES = 8_000_000  # of blocks in one Arrow batch


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Payload of a chunk-coded body; None if the framing is broken or ends early."""
    parts, at = [], 0
    while True:
        end = body.find(BREAK, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        if end + 2 + size + 2 > len(body) or body[end + 2 + size:end + 4 + size] != BREAK:
            return None
        parts.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the blank line that ends it (Spark's writer adds that)."""
    head = [VERSION] + [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return BREAK.join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block


def row_records(id_: str, url: str | None, payload: bytes, refers: str | None, digest_: str, segment_bytes: int) -> Iterator[bytes]:
    """The record of one row, or its first segment and continuations."""
    kind = "response" if refers is None else "revisit"
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{id_}>"), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest_}"),
              ("WARC-Refers-To", None if refers is None else f"<{refers}>"), ("Content-Type", "application/http; msgtype=response")]
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if refers is not None:
        block = BREAK.join([*http, b"Content-Length: %d" % len(payload), b"", b""])
    else:
        block = BREAK.join([*http, b"Transfer-Encoding: chunked", b"", b""]) + chunked(payload)
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    count = -(-len(block) // segment_bytes)
    for i in range(count):
        part = block[i * segment_bytes:(i + 1) * segment_bytes]
        if i == 0:
            yield record([*fields, ("WARC-Segment-Number", 1)], part)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{id_}:{i + 1}>"), ("WARC-Segment-Origin-ID", f"<{id_}>"),
                          ("WARC-Segment-Number", i + 1), ("WARC-Segment-Total-Length", len(block) if i == count - 1 else None)], part)


def _write_rows(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in zip(*(batch.column(c) for c in ("id", "url", "payload", "last", "copy"))):
                id_, url, payload, last, copy = (x.as_py() for x in r)
                raw = (payload or "").encode()
                d = digest(raw)
                refers = None if last is None else f"urn:page:{last}:{d}:1"
                for value in row_records(f"urn:page:{id_}:{d}:{copy}", url, raw, refers, d, segment_bytes):
                    out.append(value)
                    held += len(value)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write(df: DataFrame, path: str, id_: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
          segment_bytes: int = 65536, records_per_file: int = 2000) -> None:
    """Archive every row under ``path``."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    id_text = F.coalesce(F.col(f"`{id_}`").cast("long").cast("string"), F.lit("null"))
    rows = df.select(F.col(f"`{id_}`").cast("long").alias("id"), id_text.alias("key"), F.col(f"`{url}`").alias("url"), body.alias("payload"),
                     F.sha1(body.cast("binary")).alias("sha"))
    # equal payloads meet as ids and digests only; payloads are dealt by their row's own id
    keys = rows.where(F.octet_length("payload") >= least_bytes).select("id", "key", "sha").distinct()
    last = keys.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    revisits = (keys.join(last, "sha").where(~F.col("id").eqNullSafe(F.col("last")))
                .select("key", "sha", "last"))
    decided = rows.join(revisits, ["key", "sha"], "left")
    copy = F.row_number().over(Window.partitionBy("key", "sha").orderBy("url"))  # dealt as the join dealt them
    named = decided.select("id", "url", "payload", "last", copy.alias("copy"))
    values = named.mapInArrow(_write_rows(segment_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    (values.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive, one after another."""
    while line := stream.readline():
        if line.strip() != VERSION:
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        yield {"fields": fields, "block": stream.read(int(fields.get("content-length", 0)))}


def _unbracket(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def _row(rec: dict) -> dict:
    f = rec["fields"]
    return {"record_id": _unbracket(f.get("warc-record-id")), "record_type": f.get("warc-type"), "url": f.get("warc-target-uri"),
            "digest": f.get("warc-payload-digest"), "refers_to": _unbracket(f.get("warc-refers-to")),
            "segment": int(f["warc-segment-number"]) if "warc-segment-number" in f else None, "origin": _unbracket(f.get("warc-segment-origin-id")),
            "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "block": rec["block"]}


def _batches(rows: Iterator[dict], schema: pa.Schema, weigh: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"")
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """All records of the archives under ``path``, or only those that are (not) part of a segmented record."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for content in batch.column(0):
                    raw = content.as_buffer()
                    stream = gzip.GzipFile(fileobj=pa.BufferReader(raw)) if raw[:2] == b"\x1f\x8b" else pa.BufferReader(raw)
                    for rec in parse(io.BufferedReader(stream, 1 << 18)):
                        row = _row(rec)
                        if segmented is None or segmented == (row["segment"] is not None):
                            yield row

        yield from _batches(rows(), _arrow(RECORDS), "block")

    return files.mapInArrow(run, RECORDS)


def _payload(row: dict, block: bytes | None) -> dict:
    """Decode the HTTP block of a whole record."""
    out = {k: row[k] for k in ("record_id", "record_type", "url", "refers_to")}
    payload, n, d = None, None, None
    if block is not None:
        head, _, body = block.partition(BREAK * 2)
        http = dict(line.lower().split(b": ", 1) for line in head.split(BREAK)[1:] if b": " in line)
        if row["record_type"] == "revisit":  # no body: length and digest are those of the record it refers to
            n, d = int(http.get(b"content-length", 0)), (row["digest"] or "").removeprefix("sha1:")
        else:
            payload = unchunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
            if payload is not None:
                n, d = len(payload), digest(payload)
    return out | {"payload": payload, "payload_bytes": n, "payload_digest": d, "complete": n is not None}


def _decode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((_payload(row, row["block"]) for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()), _arrow(RESULT), "payload")


def reassembled(rows: Iterator[dict]) -> Iterator[dict]:
    """Join the segments of rows sorted by (origin, segment); a gap, a repeat or a wrong total makes a record incomplete."""
    first, parts, total, good = None, [], None, True

    def finish() -> dict:
        block = b"".join(parts)
        return _payload(first, block if good and total == len(block) else None)

    for row in rows:
        if row["segment"] == 1:
            if first is not None:
                yield finish()
            first, parts, total, good = row, [row["block"]], None, True
        elif first is not None and row["origin"] == first["record_id"]:
            good = good and row["segment"] == len(parts) + 1 and total is None
            total = row["total"]
            parts.append(row["block"])
    if first is not None:
        yield finish()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(reassembled(row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()), _arrow(RESULT), "payload")


def assemble(segments: DataFrame) -> DataFrame:
    """Segmented records: grouped by the record they belong to, ordered by segment number, joined and decoded."""
    origin = F.coalesce("origin", "record_id")
    dealt = segments.withColumn("group", origin).repartition("group").sortWithinPartitions("group", "segment")
    return dealt.drop("group").mapInArrow(_assemble, RESULT)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every archived row again: (record_id, record_type, url, refers_to, payload, payload_bytes, payload_digest, complete)."""
    whole = records(spark, path, segmented=False).mapInArrow(_decode_whole, RESULT)
    return whole.unionByName(assemble(records(spark, path, segmented=True)))
