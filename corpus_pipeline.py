"""A corpus pipeline of five operators: STAGES over the documents table, each stage's rows written and read again.

language ID, quality classifier, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopmark.llm import bpe, decontaminate, importance, language_id, simhash
from hopmark.llm.common import read_table, work_dir
from hopmark.llm.queries import TOKENIZER


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters, or of which no language has half the probability, go."""
    return language_id.keep_identified(docs, language_id.fit_on(docs))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return importance.keep_selected(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item occurs, however long they are."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts."""
    return bpe.encode_decode(docs, TOKENIZER, digest=True)


STAGES = [("language ID", identified), ("quality classifier", of_quality), ("SimHash near-dedup", without_copies), ("benchmark decontamination", without_benchmark), ("BPE encoding and decoding", encoded)]

#: SQL can express neither the fitted models nor the fingerprints; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
    return docs
