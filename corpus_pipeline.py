"""Training-data pipeline: stages that each take the documents their predecessor kept.

A stage is a function of a session, its documents and the folder of the tables.
What it returns is written as Parquet and read again as the next one's documents.
All but the last return the columns of documents.

ORACLE_SQL is None: neither compression, MinHash nor BPE can be put in SQL. The
tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hackney.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from hackney.llm.common import checkpoint_folder, documents
from hackney.llm.queries import CODE_VOCABULARY, table, vocabulary


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return quality.without_poor(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of near-duplicates, which share 0.8 of their runs of five words."""
    return near_dedup.without_near_copies(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the tokens and of the text decoded from them."""
    return bpe.round_trip_digests(docs, vocabulary(CODE_VOCABULARY))


STAGES = [
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' results are written to the folder that all executors share."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
