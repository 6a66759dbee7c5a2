"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, common, decontamination, exact_dedup, jaccard_join, toxicity

#: Learnt scores can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with similar shingle sets, the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids and the digests of ids and decoded text of what is left."""
    return bpe_codec.with_digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        # what a stage wrote on its way, and its input if that is ours, go once its result is written
        with common.clearing(spark) as made:
            docs = common.kept(made, common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            common.delete(spark, before)
        before = docs.staged_at
    return docs
