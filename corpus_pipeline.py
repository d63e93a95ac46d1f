"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language: documents whose language is not identified go;
2. near_copies: of each component of near copies (five-word shingles, Jaccard 0.75 or more) one document stays, that
   with the smallest id, null last (of rows that share it, the first by their texts' hash);
3. decontaminate: documents contaminated with benchmark passages go;
4. secrets: every document stays, its secrets are cut out of the text;
5. packing: the texts become sequences of at most 1024 tokens, a row per piece.

Stages 1 to 4 return the columns of ``documents``. Rows are documents of their own, even where they share an id or have
none: only copies go. Null and empty texts are no copies of each other, texts of any length are judged whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import decontaminate, jaccard, language, packing, secrets
from ragspark.llm.queries import table, tokenizer_path
from ragspark.llm.shared import fresh, noted, remove, save


_tables: dict[str, list[str]] = {}


def stage(f):
    """A stage whose own tables go when the next one starts: by then its result is written and read again."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _tables.setdefault(spark.sparkContext.applicationId, [])
        remove(spark, held)
        with noted() as made:
            out = f(spark, docs, sf_dir)
        held.extend(made)
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where ids are unique, a component's smallest id names the document that stays, so one narrow join decides.
    Where some are not, the rows are numbered first, and the numbers take the ids' part."""
    shared = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        named = save(jaccard.join(docs).where("doc_id = component_id").select("doc_id"), "kept")
        # A merge join at every size: it is the same plan for ten thousand ids and for ten billion.
        return docs.join(named.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    row = fresh(docs.columns, "row_")
    own = save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    component = jaccard.join(own, key=row).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    ids = own.select(row, "doc_id", "text").join(component, row).groupBy("component_id").agg(F.min(order).alias("first"))
    named = save(ids.select(F.col(f"first.{row}").alias(row)), "kept")
    return own.join(named.hint("merge"), row, "left_semi").select(*docs.columns)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, str(tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_id),
    ("near_copies", near_copies),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL has no tokenizer and no trained classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = save(apply(spark, docs, sf_dir), name)
    return docs
