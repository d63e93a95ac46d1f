"""BM25+ from an index in the order of impact: postings lie in blocks of falling weight, and a batch of queries reads
only the blocks that can still lift a document among its best.

A posting's weight (what its term adds to a document's score) is its impact, which follows from the document alone, times
the term's rarity. Both are fixed when the index is built, so each block has an upper bound. A search takes three steps. The first block of each term gives partial scores; the documents that lead by
them are scored in full, and the k-th best of a query is its floor. The query's terms, frequent ones first, share that
floor out as allowances: only a weight above its term's allowance makes a candidate, as a document without one stays
below the floor. Candidates that could still reach it with the allowances of the terms in which they were not seen are
scored in full. What a search makes on the way is saved, so the planner knows its size and broadcasts it or not. The
result is that of ``lexical.top(lexical.bm25(...), k, query)``, ties included.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions import text as T
from ragspark.operators import lexical
from ragspark.operators.tables import saved

#: Postings of a block at most.
BLOCK = 128
#: Scores are rounded to six digits before they are ranked; what is this far below the floor rounds to less.
MARGIN = 2e-6
#: How many leaders are scored for the floor, for each document wanted. More of them raise it; the result is the same.
LEADERS = 4


@dataclass
class BlockIndex:
    """``blocks`` (shard, term, bound, n, postings of (impact, key), heaviest first) by shard, and ``terms`` (term, shard, df,
    idf, best: the greatest weight)."""

    blocks: DataFrame
    terms: DataFrame


def _in_blocks(most: int):
    """Postings sorted by term and falling impact as blocks of ``most`` at most; none spans two batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            term = b["term"]
            first = np.flatnonzero(np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)))
            runs = np.diff(np.append(first, n))
            starts = np.flatnonzero((np.arange(n) - np.repeat(first, runs)) % most == 0)
            ends = np.append(starts, n).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([b["impact"], b["key"]], ["impact", "key"]))
            made = [term.take(pa.array(starts)), b["impact"].take(pa.array(starts)), pa.array(np.diff(ends)), lists, b["shard"].take(pa.array(starts))]
            yield pa.record_batch(made, ["term", "bound", "n", "postings", "shard"])

    return run


def _counted(words: DataFrame) -> DataFrame:
    """(key, dl, term, tf) of (key, t): a document's words are sorted and counted inside its row, without a shuffle."""
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = words.where(F.size("t") > 0).select("key", F.array_sort("t").alias("t")).select("key", "t", first.alias("first"))
    each = F.transform("first", lambda i, at: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("first", at + 1), F.size("t")) - i).cast("long").alias("tf")))
    return runs.select("key", F.size("t").cast("long").alias("dl"), F.explode(each).alias("e")).select("key", "dl", "e.term", "e.tf")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 64) -> BlockIndex:
    """The index of ``docs``, written below ``path`` (which must not exist yet) in ``shards`` folders; more of them make
    a search of few words read less of a large index. A null text has no words but counts as a document, and so does a
    row without a key, which is never found; an empty table gives an index without terms; rows that repeat a key and a
    length are one document with all their words, and those of another length add to it (both cost a shuffle more). Postings are sorted by range of term and impact, so a word of every
    document is spread over as many tasks as it needs, and a block holds 128 postings of one term at most."""
    row = lexical.statistics(docs, text).first()
    each = _counted(docs.select(F.col(key).alias("key"), T.tokens(F.col(text)).alias("t")))
    repeated = not docs.groupBy(key).count().where("count > 1").isEmpty()
    if repeated:
        each = each.groupBy("term", "key", "dl").agg(F.sum("tf").alias("tf"))
    impact = lexical._weight(F.col("tf"), F.col("dl"), F.lit(row["avgdl"] or 1.0)).alias("impact")
    postings = each.select("term", "key", impact)
    if repeated:
        postings = postings.groupBy("term", "key").agg(F.sum("impact").alias("impact"))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    order = ["shard", "term", F.desc("impact"), "key"]
    ranged = postings.select(shard, "term", "impact", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = f"term string, bound double, n int, postings array<struct<impact: double, key: {docs.schema[key].dataType.simpleString()}>>, shard int"
    ranged.mapInArrow(_in_blocks(BLOCK), kind).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")
    terms = docs.sparkSession.read.schema(kind).parquet(f"{path}/blocks").groupBy("term", "shard").agg(F.sum("n").alias("df"), F.max("bound").alias("most"))
    idf = lexical.idf(F.lit(row["n"]), F.col("df"))
    terms.select("term", "shard", "df", idf.alias("idf"), (idf * F.col("most")).alias("best")).write.option("compression", "zstd").parquet(f"{path}/terms")
    return opened(docs.sparkSession, path, kind)


def opened(spark: SparkSession, path: str, kind: str | None = None) -> BlockIndex:
    """The index that ``build`` wrote to ``path``; ``kind`` is the schema of its blocks, needed if it has none."""
    return BlockIndex((spark.read.schema(kind) if kind else spark.read).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"))


def _of(index: BlockIndex, terms: DataFrame) -> DataFrame:
    """The blocks of the terms: only the folders that hold one are listed and read."""
    shards = sorted(r["shard"] for r in terms.select("shard").distinct().collect())  # as many numbers as there are folders, at most
    return index.blocks.where(F.col("shard").isin(shards)).drop("shard")


def _scored(blocks: DataFrame, words: DataFrame, candidates: DataFrame, query: str) -> DataFrame:
    """(query, key, score) of the candidates (query, key), from all blocks of the queries' words (query, term, idf)."""
    each = blocks.join(words, "term").select(query, "idf", F.explode("postings").alias("p")).select(query, "p.key", (F.col("p.impact") * F.col("idf")).alias("weight"))
    return each.join(candidates, [query, "key"], "left_semi").groupBy(query, "key").agg(F.sum("weight").alias("score"))


def _first(df: DataFrame, query: str, by: str, n: int) -> DataFrame:
    """``df`` with its place ``nth`` by falling ``by`` in each query, up to ``n``."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(by)))).where(F.col("nth") <= n)


def _allowances(blocks: DataFrame, mine: DataFrame, k: int, query: str) -> DataFrame:
    heads = blocks.join(mine.select(query, "term", "idf", "best"), "term").where(F.col("idf") * F.col("bound") == F.col("best"))
    partial = heads.select(query, "idf", F.explode("postings").alias("p")).groupBy(query, "p.key").agg(F.sum(F.col("p.impact") * F.col("idf")).alias("partial"))
    leaders = saved(_first(partial, query, "partial", LEADERS * k).select(query, "key"), "leaders")
    scored = _scored(blocks, mine.select(query, "term", "idf"), leaders, query)
    floors = _first(scored, query, "score", k).where(F.col("nth") == k).select(query, F.greatest(F.col("score") - MARGIN, F.lit(0.0)).alias("floor"))
    before = Window.partitionBy(query).orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, -1)
    known = mine.join(floors, query, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    left = F.col("floor") - F.coalesce(F.sum("best").over(before), F.lit(0.0))
    return saved(known.withColumn("allowance", F.greatest(F.least(F.col("best"), left), F.lit(0.0))), "allowances")


def _mine(index: BlockIndex, queries: DataFrame, query: str, query_text: str) -> DataFrame:
    words = lexical.query_terms(queries, query, query_text)
    return saved(index.terms.join(words, "term").select(query, "term", "df", "idf", "best", "shard"), "terms")


def allowances(index: BlockIndex, queries: DataFrame, k: int, query: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query, term, df, idf, best, shard, floor, allowance): ``floor`` is a score that k documents of the query reach, less
    the margin (0 if fewer are known); the allowances of a query add up to it at most."""
    mine = _mine(index, queries, query, query_text)
    return _allowances(_of(index, mine), mine, k, query)


def blocks_read(index: BlockIndex, shares: DataFrame) -> DataFrame:
    """One row: for every query of ``allowances`` the blocks of its terms, and those of them that make candidates."""
    each = _of(index, shares).select("term", "bound").join(shares.select("term", "idf", "allowance"), "term")
    return each.agg(F.count("*").alias("blocks"), F.count_if(F.col("idf") * F.col("bound") > F.col("allowance")).alias("read"))


def search(index: BlockIndex, queries: DataFrame, k: int, key: str = "doc_id", query: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query, key, score, rank): the ``k`` best documents of every query that has a word of the index, by rounded score
    and then key. A query without known words has no row; repeated words count once, null texts hold none."""
    mine = _mine(index, queries, query, query_text)
    blocks = _of(index, mine)
    shares = _allowances(blocks, mine, k, query)
    open_terms = shares.where(F.col("best") > F.col("allowance")).select(query, "term", "idf", "allowance")
    above = blocks.join(open_terms, "term").where(F.col("idf") * F.col("bound") > F.col("allowance"))
    beyond = F.col("p.impact") * F.col("idf") - F.col("allowance")
    gained = above.select(query, "idf", "allowance", F.explode("postings").alias("p")).where(beyond > 0).groupBy(query, "p.key").agg(F.sum(beyond).alias("gain"))
    given = shares.groupBy(query, "floor").agg(F.sum("allowance").alias("given"))
    # A term that was not seen adds its allowance at most.
    candidates = saved(gained.join(given, query).where(F.col("gain") + F.col("given") >= F.col("floor")).select(query, "key"), "candidates")
    scored = _scored(blocks, mine.select(query, "term", "idf"), candidates, query)
    return lexical.top(scored.withColumnRenamed("key", key), k, query, key=key)
