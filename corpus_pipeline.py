"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one what it computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fanchart.llm import bpe, decontaminate, pii, quality, simhash
from fanchart.llm.queries import PATTERN, VOCABULARY, table
from fanchart.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's input, rejects go.

    Null and empty texts are scored like any other; repeated rows are scored alike and all go or stay.
    """
    classifier = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return quality.score_documents(docs, classifier).filter("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: one with the smallest doc_id, of several texts of that id the one
    with the smallest fingerprint, of equal rows any.

    Null and empty texts have the fingerprint 0 and are a group like any other. Null ids come last; a group without an id
    keeps one row too. Texts of any length are read whole; columns besides those of documents are dropped.
    """
    printed = simhash.with_fingerprints(docs.select(*COLUMNS))
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp"))
    kept = groups.groupBy("root").agg(first.alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.fp").alias("kept_fp"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("kept_fp"))
    return printed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "fp"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no word inside a benchmark window stay, among them null and empty texts; repeated rows alike."""
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination(docs, benchmark).filter(~F.col("contaminated")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, is replaced by its kind; n_chars follows. A null text stays null, rows stay rows."""
    redacted = pii.redact_personal_data(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded, with the digest of its ids and of what they decode to; a null text is empty."""
    return bpe.token_digests(docs.select("doc_id", "text"), VOCABULARY, PATTERN).drop("text")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

# Several stages run numpy or an external tokenizer; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
