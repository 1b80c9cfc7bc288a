"""Corpus pipeline: toxic documents, exact copies and near copies go, sources are mixed, the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each stage's result as
Parquet in the shared folder and reads it back. All stages but the last return the columns of documents. Stages keep
rows with null or empty texts (one of them, after exact deduplication) unless the classifier rejects them, keep clean
documents, and give an empty table for an empty table. The mix repeats a document as often as it takes it.
In every stage null, repeated and tied ids, null sources, repeated rows and very long texts are judged row by row by the
text: an id that many rows share takes no other row with it, and of equal rows the stages keep or drop any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from tabscope.llm.queries import coded_digests
from tabscope.llm.store import saved
from tabscope.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, learnt on the labelled rows outside the held-out fold; documents predicted toxic go."""
    prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; of equal texts the row with the smallest doc_id stays."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; of each component of near duplicates the document with the smallest doc_id stays."""
    prepare(spark)
    return jaccard_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; each document as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; n_tokens and digests of ids and decoded text of each row, repeats included."""
    prepare(spark)
    return coded_digests(bpe.encode(docs, decoded="decoded"), "doc_id", "source")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

ORACLE_SQL = None  # the classifier can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages and run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
