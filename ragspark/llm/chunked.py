"""Texts in chunks, and the exchange of fingerprints between them.

A chunk is a row with 1 to 16 MB of compressed texts: the larger the corpus, the more buckets it has, and the larger
its chunks, so that a message to a bucket stays worth its row. What a chunk does depends on the buckets it has
something for, never on the number of all. The chunk table is written once, bucketed by chunk, so joining
small results back to it moves no text. Chunks send packed rows (bucket, chunk, payload) to the tasks that own the
buckets of a hash space; what comes back is keyed by (chunk, bucket) and refers to a payload's entries by their
order, which the chunk derives again. So a question about every position of the corpus costs a few bytes a position
and the answer a bit.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel as K
from ragspark.llm.shared import new_path, small_batches

#: Bytes of text in a chunk: LIMIT up to CORPUS bytes, then as the square root of the corpus, up to MOST.
LIMIT, CORPUS, MOST = 1 << 20, 64 << 30, 16 << 20
SENT = "bucket int, chunk long, payload binary"
BACK = "chunk long, bucket int, payload binary"


@dataclass
class Chunks:
    """The table, the number of its buckets on disk, and the bytes of text."""

    table: DataFrame
    parts: int
    size: int

    def buckets(self, bytes_each: int) -> int:
        """A power of two, so that a bucket of the hash space gets about ``bytes_each`` bytes of text's positions."""
        return 1 << max(4, int(np.ceil(np.log2(max(1, self.size / bytes_each)))))


def chunk_bytes(size: int) -> int:
    return int(min(MOST, max(LIMIT, LIMIT * (size / CORPUS) ** 0.5)))


@dataclass
class Spans:
    """The buckets that occur, ascending, and where each one's entries begin (one more at the end)."""

    bucket: np.ndarray
    begin: np.ndarray

    @classmethod
    def of_sorted(cls, own: np.ndarray) -> Spans:
        """``own``: the entries' buckets, ascending."""
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        return cls(own[head].astype(np.int64), np.append(head, len(own)))

    def __iter__(self):
        return zip(self.bucket.tolist(), self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True)

    def at(self, bucket: int) -> tuple[int, int]:
        """Where the entries of an occurring bucket begin and end."""
        i = int(np.searchsorted(self.bucket, bucket))
        return int(self.begin[i]), int(self.begin[i + 1])


def build(docs: DataFrame, key: str, text: str, limit: int | None = None) -> Chunks:
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    limit = limit or chunk_bytes(size)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (128 << 20)))

    def run(batches):
        base, n, pack = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=6)
        held: list = []

        def flush():
            nonlocal n
            ids = pa.concat_arrays([r.column(0) for r, _, _ in held])
            off = np.cumsum(np.concatenate([[0], *[np.diff(o) for _, _, o in held]])).astype("<i8")
            body = pack.compress(np.concatenate([d for _, d, _ in held]).tobytes())
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([base + n - 1], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([off.tobytes()], pa.binary()), pa.array([body], pa.binary())], names=["chunk", "ids", "off", "body"])

        full = 0
        for rows, data, off in K.chunks(batches, "text", limit):
            if held and full + len(data) > limit:
                yield flush()
                held, full = [], 0
            held.append((rows, data, off))
            full += len(data)
        if held:
            yield flush()

    path, name = new_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex}"
    made = narrow.mapInArrow(run, "chunk long, ids array<long>, off binary, body binary")
    made.write.option("path", path).option("compression", "none").bucketBy(parts, "chunk").format("parquet").saveAsTable(name)
    return Chunks(spark.table(name), parts, size)


def unpack(off: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk."""
    return np.frombuffer(zstandard.decompress(body) if body else b"", np.uint8), np.frombuffer(off, "<i8")


def rows_of(batches, columns: list[str]):
    """The rows of Arrow batches, one at a time."""
    for b in batches:
        at = [b.column(b.schema.get_field_index(c)) for c in columns]
        for i in range(b.num_rows):
            yield tuple(c[i] for c in at)
    K.release()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The first bits."""
    return hashes >> K.U64(64 - (buckets.bit_length() - 1))


def bucket_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, Spans]:
    """Indices in the order of their buckets (stable), and the buckets' spans."""
    bits = buckets.bit_length() - 1
    own = bucket_of(hashes, buckets).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(own, kind="stable")
    return order, Spans.of_sorted(own[order])


def distinct(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spans]:
    """The distinct hashes (so in the order of their buckets), how often each is there, the index of each given one
    among them, and the buckets' spans. A chunk asks once about a hash that many of its texts hold."""
    values, own, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return values, count, own, Spans.of_sorted(bucket_of(values, buckets))


def fingerprint(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits that follow the bucket's."""
    return (hashes >> K.U64(32 - (buckets.bit_length() - 1))).astype(np.uint32)


def told(answers: dict[int, bytes], spans: Spans, n: int) -> np.ndarray:
    """The bits of the answers, by bucket, as one mask over the ``n`` hashes with these spans."""
    mask = np.zeros(n, bool)
    for b, bits in answers.items():
        i, j = spans.at(b)
        mask[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
    return mask


def sent(chunk: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([p for _, p in parts], pa.binary())], names=["bucket", "chunk", "payload"])


def meet(messages: DataFrame, parts: int, answer) -> DataFrame:
    """``answer(bucket, [payload, ...])`` gives a payload or None for each; rows (chunk, bucket, payload)."""

    def run(batches):
        def told(bucket, chunks, payloads):
            out = [(c, p) for c, p in zip(chunks, answer(bucket, payloads), strict=True) if p is not None]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["chunk", "bucket", "payload"])

        now, chunks, payloads = None, [], []
        for bucket, chunk, payload in rows_of(batches, ["bucket", "chunk", "payload"]):
            bucket = bucket.as_py()
            if bucket != now and chunks:
                yield told(now, chunks, payloads)
                chunks, payloads = [], []
            now = bucket
            chunks.append(chunk.as_py())
            payloads.append(payload.as_py())
        if chunks:
            yield told(now, chunks, payloads)

    return messages.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, BACK)


def joined(chunks: Chunks, **answers: DataFrame) -> DataFrame:
    """The chunk table with a column of (bucket, payload) for each table of answers."""
    out = chunks.table
    for name, df in answers.items():
        own = df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
        out = out.join(own.hint("shuffle_hash"), "chunk", "left")
    return out


def payloads(column) -> dict[int, bytes]:
    return {x["bucket"]: x["payload"] for x in column.as_py() or []}
