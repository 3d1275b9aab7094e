"""Change-level features: size, spread and entropy of commits, author experience, censoring and time splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.operators.inference import indexed

#: Lines of commits that one task sums.
TASK_LINES = 250_000


def numstat(lines: Column) -> Column:
    """``la, ld, path`` of a numstat line; what is no number counts 0, a line without three fields is null."""
    p = F.split(lines, "\t")
    number = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("long"), F.lit(0))
    return F.when(F.size(p) == 3, F.struct(number(1).alias("la"), number(2).alias("ld"), F.try_element_at(p, F.lit(3)).alias("path")))


def features(files: DataFrame) -> DataFrame:
    """``sha, la, ld, nf, nd, ns, churn, entropy`` from ``sha, path, la, ld``.

    Entropy is that of the shares of churn, in bits, files without churn left out.  A file in the root has the folder
    ``""`` and is its own first segment.  Lines are dealt out by commit, in tasks whose number follows theirs, before anything is
    summed: sums before would be as large as what a task reads.  Files, folders and first segments are then summed one after
    the other where they are, as a folder that is not the root's has one first segment.
    """
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(files.count() / TASK_LINES))
    f = files.select("sha", "path", "la", "ld").repartition(tasks, "sha").groupBy("sha", "path").agg(F.sum("la").alias("la"), F.sum("ld").alias("ld"))
    parts = F.split("path", "/")
    f = f.withColumn("dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).withColumn("top", F.element_at(parts, 1)).withColumn("churn", F.col("la") + F.col("ld"))
    f = f.withColumn("__s", F.when(F.col("churn") > 0, F.col("churn") * F.log2(F.col("churn").cast("double"))))
    sums = [F.sum(c).alias(c) for c in ("la", "ld", "churn", "__s")]
    f = f.groupBy("sha", "top", "dir").agg(*sums, F.count("*").alias("nf"))
    f = f.groupBy("sha", "top").agg(*sums, F.sum("nf").alias("nf"), F.count_if(F.col("dir") != "").alias("nd"), F.max((F.col("dir") == "").cast("long")).alias("__root"))
    none = F.lit(0).cast("long")
    out = f.groupBy("sha").agg(*sums, F.sum("nf").alias("nf"), (F.sum("nd") + F.coalesce(F.max("__root"), none)).alias("nd"), F.count("top").alias("ns"))
    out = out.select("sha", "la", "ld", *(F.coalesce(c, none).alias(c) for c in ("nf", "nd", "ns")), "churn", "__s")
    # -sum(p log2 p) with p = churn / total, by sums alone
    entropy = F.when(F.col("churn") > 0, F.log2(F.col("churn").cast("double")) - F.col("__s") / F.col("churn")).otherwise(0.0)
    return out.withColumn("entropy", entropy).drop("__s")


def experience(commits: DataFrame) -> DataFrame:
    """Adds ``exp``: how many commits of the author come before, those that are dropped later included.  An author with very
    many commits is many ranges, not a task."""
    return indexed(commits, ["author"], ["ct", "sha"], "exp")


def right_censored(commits: DataFrame, gap_days: int) -> DataFrame:
    """Commits old enough to have had their fixes: at most the last time less the gap."""
    last = commits.agg(F.max("ct").alias("__last"))
    return commits.crossJoin(F.broadcast(last)).where(F.col("ct") <= F.col("__last") - gap_days * 86400).drop("__last")


def time_split(commits: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``train``: whether a commit is among the first ``floor(share * n)`` in time."""
    from hornbeam.operators.ranking import running

    n = commits.agg(F.count("*").alias("__n"))
    at = running(commits.withColumn("__one", F.lit(1).cast("long")), [], [F.col("ct"), F.col("sha")], {"__at": "__one"})
    return at.crossJoin(F.broadcast(n)).withColumn("train", F.col("__at") <= F.floor(F.lit(share) * F.col("__n"))).drop("__one", "__at", "__n")


def effort_by_score(df: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """Precision and recall of the changes inspected by descending score within a share of all churn."""
    from hornbeam.operators.ranking import effort

    return effort(df.withColumn("score", -F.col("risk")), by, "score", share, "churn", "y")
