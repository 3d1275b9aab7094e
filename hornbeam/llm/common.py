"""Shared pieces: reading tables, reliable materialisation and connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.sources.store import discard, scratch, shared_dir, written

__all__ = ["components", "discard", "few_at_a_time", "partitions", "scratch", "shared_dir", "stash", "table", "tidy"]
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are gone; it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def few_at_a_time(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """For what runs in the block, Python gets batches of a few rows: rows of a megabyte in batches of the usual 10,000 would
    be a whole partition in the memory of both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    ``stash_path`` on the returned frame names the folder; :func:`discard` removes it once nothing reads it, and
    :func:`scratch` all those of a block.  ``wide`` is for rows of a megabyte or so.
    """
    out = written(df, "stash", wide)
    del df  # with it goes what its shuffles keep on disk
    tidy(out.sparkSession)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns ``node, component`` where the component is the least node of it.  Self loops and nulls are ignored; no
    edges give no rows.  Every round's edge list goes to the shared folder, and the driver sees only two sums a round.
    A node with very many neighbours is no task of its own: its minimum is a partial aggregate and the join back to
    its neighbours can be split.
    """
    work = stash(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = work.select("u", "v").unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        first = stash(large)
        floor = first.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            first.join(floor, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(floor.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = stash(small)
        n, digest = after.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        discard(first)
        discard(work)
        work = after
        if (n, digest) == before:
            break
        before = (n, digest)
    out = work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    return out
