"""A corpus pipeline: toxicity, exact copies, near copies, benchmark passages, mixture of sources.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it as Parquet into the
shared folder and hands what it reads back to the next stage. All stages but the last return the
columns of docs. Nulls, empty texts, repeated rows and further columns are treated as the operators
define: a document without text is not toxic, all documents without text are copies of one another,
and it shares no passage. Of rows that repeat id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtoll.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from airtoll.llm.common import in_fold, table
from airtoll.sources.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 3, 1))
    return toxicity.drop_rejected(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, but for the case of A-Z, the one with the largest id."""
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Near duplicates share 80 % or more of their shingles. At that threshold 24 keys a side miss a pair
    with a chance below 6.4e-6.
    """
    return near_dedup.keep_smallest(docs, percent=80, m=24)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, copies, block_rank, place and shortfall of every document: 1.9 times the tokens, no
    source passed more than twice."""
    return mixing.mix(docs, budget_share=1.9, repeats=2.0)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontamination", drop_benchmark_passages), ("mixing", mix_sources)]

#: The toxicity stage is a trained model, which SQL can't express; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
