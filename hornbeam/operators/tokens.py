"""Token counts by byte-pair merges, from a table of ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks that may be broadcast; a larger vocabulary is refused.
MAX_RANKS = 400_000
#: Fixed value: the pattern that the public byte-level vocabularies split a text by before they merge.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``token, rank`` from a file of lines with a token in base 64 and its rank; other lines are left out."""
    line = F.split("value", " ")
    return spark.read.text(path).where("value rlike '^[A-Za-z0-9+/=]+ [0-9]+$'").select(F.unbase64(line[0]).alias("token"), line[1].cast("int").alias("rank"))


def merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens that are left when the neighbours of least rank, the first of equals, are joined until none can be."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], MAX_RANKS) for i in range(len(piece) - 1)]  # of each part with the next
    while pairs:
        rank = min(pairs)
        if rank == MAX_RANKS:
            break
        at = pairs.index(rank)
        parts[at] += parts.pop(at + 1)
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], MAX_RANKS)
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], MAX_RANKS)
    return len(parts)


@lru_cache(1)
def _known(shared):
    """Counts of pieces by broadcast ranks, remembered for all tasks of a Python worker."""
    ranks = shared.value
    return lru_cache(1 << 16)(lambda piece: merged(piece.encode(), ranks))


def token_counter(ranks: DataFrame):
    """A column function: tokens of a text, null for a null text, 0 for an empty one.

    Texts are split in the JVM; a worker merges each distinct piece once and remembers the last 65,536 of up to 64 characters.
    A piece is merged in time that grows with the square of its length.  No shuffle.
    """
    spark = ranks.sparkSession
    rows = ranks.limit(MAX_RANKS + 1).collect()
    if len(rows) > MAX_RANKS:
        raise ValueError(f"more than {MAX_RANKS} ranks")
    shared = spark.sparkContext.broadcast({bytes(r["token"]): r["rank"] for r in rows})

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _known(shared)
        for batch in batches:
            yield pd.Series([None if x is None else sum(known(p) if len(p) <= 64 else merged(p.encode(), shared.value) for p in x) for x in batch], dtype="Int64")

    count = count.asNondeterministic()  # so that it is not worked out again for each use of its result
    return lambda text: count(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)))


def tokens_per_text(docs: DataFrame, ranks: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``n_tokens``; an existing column of the name is replaced.  The texts are dealt out first: a table that is
    read in fewer pieces than there are cores, as one of few groups of rows is, would leave the others idle."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return docs.repartition(tasks).withColumn("n_tokens", token_counter(ranks)(text))
