"""Corpus pipeline: documents to a clean, mixed and sharded training set.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from ledgerlake.llm.common import read_table, stored
from ledgerlake.llm.queries import N_SHARDS, held_out

# Learned scores and approximate retrieval are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled ones among them, does not reject."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that five-word Jaccard links of 0.8 connect: the least doc_id."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.emitted(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their row_number, shard and slot."""
    return sharding.shard(docs, N_SHARDS, ["doc_id", F.xxhash64("text")])


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
