"""From raw documents to packed training sequences, stage by stage. Each stage's result is written and read again.

Rows whose doc_id is null pass the filtering stages: no decision can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import bagminhash, decontaminate, language_id, packing, pii
from codequarry.session import scratch


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't in `ids`; no broadcast is forced, the plan follows the sizes."""
    return docs.join(ids.select(F.col("doc_id").alias("_drop_id")).distinct(), F.col("doc_id") == F.col("_drop_id"), "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a main language go."""
    return language_id.keep_accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document with the least doc_id stays."""
    return without(docs, bagminhash.near_duplicates(docs).filter("not keep"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: entities are replaced by their types, n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: sequences with their documents and text."""
    return packing.sequences(docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: No SQL says what the stages decide; tests hold run() against the operators' brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
