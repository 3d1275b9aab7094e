"""A training corpus from ``documents``: rules, near duplicates, decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornbeam.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from hornbeam.llm.common import discard, scratch, stash, table

#: Near duplicates share at least 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80
SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return ngram_join.keep_one(docs, k=SHINGLE, percent=PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, in globally shuffled order."""
    return mixing.shuffled(mixing.replicate(docs)).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard: SHARDS leaves of near-equal bytes."""
    return sharding.kd_shards(docs, n_shards=SHARDS).drop("shard_tie")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Compression, similarity joins and seeds are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch(spark, kept):  # what a stage wrote on its way is removed with the stage's end
            done = stash(stage(spark, docs, sf_dir))
            kept.append(done)
        discard(docs)  # the stage before; the input itself is no stash
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
