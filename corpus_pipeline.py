"""A pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents, whatever others stand beside them. Nulls, empty texts,
repeated rows and empty tables are met as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learngraph.llm import language_id, near_duplicates, packing, quality, queries, shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which most letters are of scripts that no learned language uses, and those whose trigrams are far less likely, even in the best language of each word, than those of the learned rows."""
    shared.small_batches(spark)
    model = queries.language_model(docs, calibrated=True)
    return docs.where(language_id.belongs(docs, model))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go; where no classifier could be fitted, none do."""
    shared.small_batches(spark)
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.weights is None:
        return docs
    return docs.where(quality.verdict(docs, model) >= 0.5)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    shared.small_batches(spark)
    return near_duplicates.deduplicate(docs, words=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens. Workers serve the other stages too, so they remember fewer chunks, and none after a task."""
    shared.small_batches(spark)
    return packing.pack(docs, queries.BYTE_BPE, end_id=1, size=2048, memo=250_000, keep=False)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", remove_near_duplicates),
    ("packing", pack_sequences),
]
# Learned models, components of confirmed links and the tokenizer's ids are beyond SQL: tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
