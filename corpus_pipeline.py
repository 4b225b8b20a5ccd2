"""A corpus pipeline: each stage is one operator of tarnlake.llm, written as Parquet and read again.

Stages take and return the columns of ``documents``; the last one returns each row's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import decontamination, language, minhash, mixing, sharding
from tarnlake.llm.words import table
from tarnlake.session import keep


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; those without a letter, and those that no language
    explains with a probability of one half, go. The model learns from three quarters of the labels."""
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"), 4, 2)))
    return language.accepted(docs, model)


#: similarity of near copies, and bands of 5 of which a pair at that similarity shares none with a chance of 7 in a million
PERCENT, BANDS = 80, 30


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 or more."""
    return minhash.deduplicated(docs, percent=PERCENT, bands=BANDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: 40 shards of near equal bytes, equal texts together."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs


#: language ID is not expressible in SQL
ORACLE_SQL = None
