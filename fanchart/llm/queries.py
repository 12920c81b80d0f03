"""The registered queries of this package, over the whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fanchart.llm import (
    bpe,
    centroids,
    chat,
    decontaminate,
    itq,
    pii,
    quality,
    secrets,
    sharding,
    simhash,
    substring,
    toxicity,
    whitening,
)
from fanchart.llm.oracles import SQL
from fanchart.session import cut_lineage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    # Texts are read once; what follows works on the narrow table. Rows of one id are told apart by text and number.
    records = cut_lineage(docs.select("doc_id", sharding.size_of("text").alias("size"), crc.alias("text_crc32")))
    records = sharding.told_apart(records, "doc_id", "text_crc32", "size")
    records = records.withColumn("virtual_slot", sharding.virtual_slot("_record", "_repeat"))
    records = cut_lineage(records.drop("_record", "_repeat"))
    usage = cut_lineage(sharding.slot_bytes(records))
    # Version 1 of the map, and version 2 after a ninth shard was added: the edit that rebalancing makes.
    first = sharding.initial_map(usage, SHARDS)
    slot_map = cut_lineage(first.unionByName(sharding.grown_map(first, usage)))
    placed = sharding.place(records, slot_map.filter("version = 1"), "doc_id")
    # At most as many rows as there are slots.
    later = slot_map.filter("version = 2").select("virtual_slot", F.col("shard").alias("shard_version_2"))
    return placed.join(F.broadcast(later), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "shard_version_2",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY, PATTERN).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).drop("text")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_windows(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        role.alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    formatted = chat.format_turns(turns.unionByName(extra), VOCABULARY, PATTERN)
    return chat.read_back(formatted, VOCABULARY, PATTERN).drop("n_tokens", "loss_tokens")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    classifier = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return quality.score_documents(docs, classifier).select("doc_id", "keep", "score", "votes")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_substring": op6_substring,
    "op7_itq": op7_itq,
    "op8_secrets": op8_secrets,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_centroids": op13_centroids,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
