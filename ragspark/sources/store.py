"""The corpus store: Parquet tables of corpora, chunks and embeddings, partitioned by corpus."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import vectors as V
from ragspark.operators.dedup import evict
from ragspark.operators.retrieve import content_hash

TTL_MS = 7 * 86_400_000


def canonical(value) -> str:
    """JSON with sorted keys and without nulls."""
    clean = lambda v: {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list) else v
    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def corpus_id(source: dict, model: str, dims: int, **chunking) -> str:
    return hashlib.sha256("|".join([canonical(source), model, str(dims), canonical(chunking)]).encode()).hexdigest()


def corpus_key(source: Column, model: str, dims: int, **chunking) -> Column:
    """``corpus_id`` of a column of canonical sources."""
    return F.sha2(F.concat_ws("|", source, F.lit(model), F.lit(str(dims)), F.lit(canonical(chunking))), 256)


class Store:
    """Writes replace a corpus's own partitions only; reads prune to them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.open: dict[str, str] = {}

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_id").parquet(f"{self.path}/{name}")

    def _read(self, name: str, corpus: str | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return df if corpus is None else df.where(F.col("corpus_id") == corpus)

    def write(self, corpus: str, chunks: DataFrame, embeddings: DataFrame, source: dict, now_ms: int, model: str, dims: int) -> bool:
        """Stores (position, text, ...) and (position, vector); an empty corpus is not stored."""
        own = chunks.withColumn("corpus_id", F.lit(corpus))
        size = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length(F.to_json(F.struct(*chunks.columns)))).alias("bytes")).collect()[0]
        if not size["n"]:
            return False
        whole = content_hash(own, "text", "position").collect()[0]["content_hash"]
        self._write(own, "chunks")
        self._write(embeddings.withColumn("corpus_id", F.lit(corpus)), "embeddings")
        head = (corpus, canonical(source), model, dims, size["n"], whole, now_ms, now_ms, size["bytes"] + 4 * dims * size["n"])
        self._write(self.spark.createDataFrame([head], "corpus_id string, source string, model string, dims int, n_chunks long, content_hash string, created_at long, last_accessed_at long, total_bytes long"), "corpora")
        return True

    def read(self, corpus: str, now_ms: int, ttl_ms: int = TTL_MS) -> tuple[DataFrame, DataFrame] | None:
        """(chunks, embeddings) unless missing, expired or damaged; marks the access."""
        heads = self._read("corpora", corpus)
        head = heads.collect() if heads is not None else []
        if not head or now_ms - head[0]["created_at"] > ttl_ms:
            return None
        head = head[0]
        chunks, vectors = self._read("chunks", corpus), self._read("embeddings", corpus)
        if chunks is None or vectors is None:
            return None
        whole = content_hash(chunks, "text", "position").collect()[0]["content_hash"]
        good = vectors.agg(F.count("*").alias("n"), F.bool_and((F.size("vector") == head["dims"]) & V.finite(F.col("vector"))).alias("ok")).collect()[0]
        if chunks.count() != head["n_chunks"] or whole != head["content_hash"] or good["n"] != head["n_chunks"] or not good["ok"]:
            return None
        self._write(self.spark.createDataFrame([head], heads.schema).withColumn("last_accessed_at", F.lit(now_ms).cast("long")), "corpora")
        return chunks.drop("corpus_id"), vectors.drop("corpus_id")

    def delete(self, *corpora: str) -> None:
        """Removes the corpora's partitions through the file system of the store."""
        jvm = self.spark._jvm
        for c in corpora:
            for name in ("corpora", "chunks", "embeddings"):
                where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/corpus_id={c}")
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def evict(self, now_ms: int, ttl_ms: int = TTL_MS, most: int = 50, most_bytes: int = 500_000_000, current: str | None = None) -> list[str]:
        """Removes expired, then least recently used corpora; returns their ids (the headers are few by design)."""
        heads = self._read("corpora")
        if heads is None:
            return []
        stay = evict(heads, now_ms, ttl_ms, most, most_bytes, current)
        gone = [r["corpus_id"] for r in heads.join(stay.select("corpus_id"), "corpus_id", "left_anti").select("corpus_id").collect()]
        self.delete(*gone)
        return gone

    def get_or_build(self, source: dict, model: str, dims: int, now_ms: int, build, ttl_ms: int = TTL_MS) -> tuple[str, DataFrame, DataFrame]:
        """The stored corpus of a source, else what ``build()`` returns (chunks, embeddings), stored."""
        corpus = corpus_id(source, model, dims)
        found = self.read(corpus, now_ms, ttl_ms)
        if found is None:
            chunks, vectors = build()
            self.write(corpus, chunks, vectors, source, now_ms, model, dims)
            found = self.read(corpus, now_ms, ttl_ms) or (chunks, vectors)
        return corpus, *found
