"""The queries of this subpackage and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import blocks, decontaminate, interaction, jaccard, language, merkle, multiindex, packing, quality, secrets, suffixes, urls, warc
from ragspark.llm.sql import SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    count = [F.size(secrets.of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.filter("findings", lambda f: f["kind"] != "generic")
    return found.select("doc_id", *count, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("findings")).alias("spans"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), str(tokenizer_path()))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("matches.item")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    rows = merkle.manifest(table(spark, sf_dir, "documents").select(*merkle.FIELDS), now={"n_chars": n_chars})
    digests = [merkle.told(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select("doc_id", *digests, merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.told(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = interaction.failures(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return interaction.audit(interaction.labelled(flags, table(spark, sf_dir, "labels"))).drop("filter")


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_copies(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
