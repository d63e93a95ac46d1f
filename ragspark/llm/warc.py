"""WARC archives: written with segmented, chunked records, read back by segment reassembly.

Writing: a record whose block exceeds ``segment_bytes`` is cut into segments: the first is a ``response`` with
segment number 1, the others are ``continuation`` records that name the first one's id as their origin; the last
gives the total length. HTTP bodies use chunked transfer framing. Of records with equal payloads of at least
``least`` bytes the one with the largest page id is the response, the others are revisits of it.

The files are written by Spark's text writer (gzip, record separator CRLF CRLF), so any store that Spark reaches
holds them, and read whole with ``binaryFile``; ``records_per_file`` times ``segment_bytes`` bounds a file.

Reading: every record of a file is parsed; one group by origin id collects the segments of a record, which are
ordered by number, checked against the total length, joined, and freed of their chunked framing.

Defined results: null html is an empty payload; html of any length is cut into segments and comes back whole; a null id or url is left out of the headers and read back as null;
rows that repeat an id and a payload are all responses (none has a smaller id); a null id counts as smaller than
any other; records with a missing segment or a wrong length have ``status`` set and a null payload; an empty table
gives archives without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.shared import new_path, save, small_batches

SEGMENT, CHUNK, RECORDS, SALTS = 1 << 15, 1 << 12, 4096, 16
CRLF, END = b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes | None:
    """The payload of a chunked body, trailers and chunk extensions dropped; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[0], 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != CRLF:
            return None
        parts.append(body[at : at + n])
        at += n + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n".encode() for k, v in fields if v is not None) + CRLF


def records(page_id, url, payload: bytes, refers_to, name: str, date: str, segment_bytes: int = SEGMENT):
    """The records of a page, each without the CRLF CRLF that follows it."""
    own = f"<urn:x-page:{'' if page_id is None else page_id}:{name}>"
    fields = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", len(payload))]
    kind = [("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), *kind, ("Content-Length", len(HTTP))]) + HTTP
        return
    block = HTTP + frame(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, part in enumerate(parts, 1):
        if n == 1:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), *kind]
        else:
            total = len(block) if n == len(parts) else None
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        yield _head([*head, ("Content-Length", len(part))]) + part


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages that revisit another."""
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).where(F.col("size") >= least)
    narrow = narrow.select("page_id", "sha", (F.abs(F.hash("page_id")) % SALTS).alias("salt"))
    last = narrow.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    last = last.select("sha", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return narrow.join(last, ["sha", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "refers_to", "sha").distinct()


def write(pages: DataFrame, path: str, least: int = 0, segment_bytes: int = SEGMENT, records_per_file: int = RECORDS, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes (page_id, url, html) to archives under ``path``."""
    small_batches(pages.sparkSession)
    again = save(revisits(pages, least), "revisits")
    rows = pages.select("page_id", "url", "html")
    if again.isEmpty():
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
        rows = rows.alias("p").join(again.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.sha") == F.col("r.sha")), "left").select("p.page_id", "url", "html", "refers_to")

    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, urls, texts, refers = (b.column(i) for i in range(4))
            for at in range(0, b.num_rows, 256):
                out = []
                for page_id, url, html, ref in zip(*(c.slice(at, 256).to_pylist() for c in (ids, urls, texts, refers)), strict=True):
                    out += records(page_id, url, (html or "").encode(), ref, f"{task}-{row}", date, segment_bytes)
                    row += 1
                off = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(out), pa.py_buffer(off), pa.py_buffer(b"".join(out)))], names=["record"])

    rows.mapInArrow(run, "record string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(body: bytes):
    """(headers, block) of each record; header names in lower case."""
    at = 0
    while at < len(body):
        end = body.index(END, at)
        head = dict(x.split(": ", 1) for x in body[at:end].decode().split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        size, at = int(head["content-length"]), end + 4
        yield head, body[at : at + size]
        at += size
        if body[at : at + 4] != END:
            raise ValueError(f"record {head.get('warc-record-id')}: wrong length")
        at += 4


def inflate(body: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while body:
        d = zlib.decompressobj(31)
        out.append(d.decompress(body))
        body = d.unused_data
    return b"".join(out)


def _page(urn: str) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+)", urn)
    return int(found[1]) if found else None


FIELDS = "origin string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, segment int, total long, block binary"


def _records(batches):
    """A row per record; the block is kept only where other segments must join it."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        for i in range(b.num_rows):
            rows, held = [], 0
            for head, block in parse(inflate(b.column(0)[i].as_py())):
                own, kind = head["warc-record-id"], head["warc-type"]
                number = head.get("warc-segment-number")
                if kind == "continuation":
                    rows.append((head["warc-segment-origin-id"], None, None, None, None, None, None, int(number), int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, block))
                elif kind == "revisit":
                    rows.append((own, _page(own), head.get("warc-target-uri"), kind, _page(head["warc-refers-to"]), head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), None, None, None))
                elif number:
                    rows.append((own, _page(own), head.get("warc-target-uri"), kind, None, None, None, int(number), None, block))
                else:
                    payload = body_of(block)
                    rows.append((own, _page(own), head.get("warc-target-uri"), kind, None, payload is not None and digest(payload) or None, None if payload is None else len(payload), None, None, None))
                held += len(block)
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def body_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(END)
    return unframe(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> tuple[str, bytes | None]:
    """(status, block) from (number, total length of the last one, bytes), in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    total = segments[-1][1]
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or total is None:
        return "missing segment", None
    block = b"".join(s[2] for s in segments)
    return ("ok", block) if len(block) == total else ("wrong length", None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, segments, status."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    one = files.mapInArrow(_records, FIELDS).groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")],
        F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "block"))).alias("parts"),
    )

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = b.slice(at, 64).to_pylist()
                for r in rows:
                    parts = r.pop("parts")
                    r["segments"], r["status"] = max(1, len(parts)), "ok"
                    if parts:
                        r["status"], block = reassemble([(p["segment"], p["total"], p["block"]) for p in parts])
                        payload = None if block is None else body_of(block)
                        r["payload_digest"], r["payload_bytes"] = (digest(payload), len(payload)) if payload is not None else (None, None)
                    if r["payload_digest"] is None and r["status"] == "ok":
                        r["status"] = "broken framing"
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segments", pa.int32()), ("status", pa.string())])
    return one.drop("origin").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, status string")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """``read`` of what ``write`` wrote to the shared folder."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
