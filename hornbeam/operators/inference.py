"""DeLong tests and bootstrap intervals.

Clusters are drawn with replacement: slot ``s`` of resample ``r`` takes index ``md5(seed|r|s) mod n``.  Rows within a
cluster are drawn by weight (:mod:`resampling`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.special import normal_tail
from hornbeam.operators import ranking as R
from hornbeam.sources.store import written


def hash_index(n: Column, *parts: Column | str) -> Column:
    """An index in [0, n) from 32 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def two_sided(z: Column) -> Column:
    """p of a normal deviate."""
    return 2 * normal_tail(F.abs(z))


def delong(df: DataFrame, by: list[str], a: str, b: str, positive: Column | str) -> DataFrame:
    """``by..., n_pos, n_neg, auc_a, auc_b, var_a, cov, var_b, delta, z``: two risks of the same rows.

    Placements come from average ranks among all and within the class, kept as doubled integers.  Covariances of a class
    with one row are 0; z is null where the variance of the difference is not positive.
    """
    d = df.withColumn("__y", R.column(positive))
    d = R.several_midranks(d, [w for x in (a, b) for w in ((by, x, f"__all_{x}"), ([*by, "__y"], x, f"__own_{x}"))])
    total = d.groupBy(*by).agg(F.count_if("__y").alias("n_pos"), F.count_if(~F.col("__y")).alias("n_neg"))
    keys = [f"__k{i}" for i in range(len(by))]
    t = total.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "n_pos", "n_neg")
    d = d.join(t, R.safe(by, keys)) if by else d.crossJoin(F.broadcast(t))
    for x in (a, b):
        place = (F.col(f"__all_{x}") - F.col(f"__own_{x}")) / 2.0
        d = d.withColumn(f"__v_{x}", F.when(F.col("__y"), F.try_divide(place, "n_neg")).otherwise(1 - F.try_divide(place, "n_pos")))
    cov = lambda x, y, c: F.coalesce(F.covar_samp(F.when(c, F.col(f"__v_{x}")), F.when(c, F.col(f"__v_{y}"))), F.lit(0.0))
    mean = lambda x: F.avg(F.when(F.col("__y"), F.col(f"__v_{x}")))
    m, n = F.max("n_pos"), F.max("n_neg")
    s = {(x, y): F.try_divide(cov(x, y, F.col("__y")), m) + F.try_divide(cov(x, y, ~F.col("__y")), n) for x, y in ((a, a), (a, b), (b, b))}
    out = d.groupBy(*by).agg(
        m.alias("n_pos"), n.alias("n_neg"), mean(a).alias("auc_a"), mean(b).alias("auc_b"), s[a, a].alias("var_a"), s[a, b].alias("cov"), s[b, b].alias("var_b")
    )
    out = out.withColumn("delta", F.col("auc_a") - F.col("auc_b"))
    var = F.col("var_a") + F.col("var_b") - 2 * F.col("cov")
    return out.withColumn("z", F.when(var > 1e-15, F.col("delta") / F.sqrt(var)))


#: Modulus of the draws, a prime.
PRIME = 2**31 - 1
def with_stream(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds ``__a`` and ``__b``: draw ``j`` of the row is ``(a + j * b) mod PRIME``."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME
    return df.withColumn("__a", part(1)).withColumn("__b", part(9))


def indexed(df: DataFrame, by: list[str], order: str | list[str], name: str) -> DataFrame:
    """Adds ``name``, the position from 0 within the group."""
    run = R.running(df.withColumn("__one", F.lit(1).cast("long")), by, [F.col(c) for c in ([order] if isinstance(order, str) else order)], {name: "__one"})
    return run.withColumn(name, F.col(name) - 1).drop("__one")


def cluster_draws(clusters: DataFrame, n: int, reps: int, seed: str) -> DataFrame:
    """``rep, slot, cluster_at``: ``n`` clusters drawn with replacement for each resample."""
    spark = clusters.sparkSession
    grid = spark.range(reps).select(F.col("id").alias("rep")).crossJoin(spark.range(n).select(F.col("id").alias("slot")))
    return grid.withColumn("cluster_at", hash_index(F.lit(n), seed, "c", F.col("rep"), F.col("slot")))


def concordance(df: DataFrame, cluster: str, risk: str, positive: Column | str) -> DataFrame:
    """``c1, c2, twice``: pairs of a positive row of one cluster and another row of the other in order, ties half, doubled.

    With it the pooled AUC of any weighting of clusters is a sum over pairs of clusters, and no resample looks at rows.
    The rows in between are distinct risks of positive rows times clusters.
    """
    per = df.groupBy(cluster, F.col(risk).alias("__r")).agg(F.count_if(R.column(positive)).alias("__p"), F.count_if(~R.column(positive)).alias("__q"))
    per = written(per, "risks")
    at = per.where("__p > 0").select("__r").distinct()
    names = per.select(F.col(cluster).alias("c2")).distinct()
    asked = at.crossJoin(F.broadcast(names)).select("c2", "__r", F.lit(0).cast("long").alias("__q"))  # clusters are few
    told = per.where("__q > 0").select(F.col(cluster).alias("c2"), "__r", "__q").unionByName(asked).groupBy("c2", "__r").agg(F.sum("__q").alias("__q"))
    run = R.running(told, ["c2"], [F.col("__r")], {"__upto": "__q"})
    pos = per.where("__p > 0").select(F.col(cluster).alias("c1"), F.col("__r").alias("__k"), "__p")
    met = pos.join(run, F.col("__k") == F.col("__r"))
    return met.groupBy("c1", "c2").agg(F.sum(F.col("__p") * (2 * F.col("__upto") - F.col("__q"))).alias("twice"))


def pooled_auc(pairs: DataFrame, counts: DataFrame, weights: DataFrame) -> DataFrame:
    """``rep, auc`` over all rows when clusters weigh ``weights(cluster, rep, weight)``: from :func:`concordance` and
    ``counts(cluster, p, q)``.  With one class only it is 0.5."""
    w1, w2 = (weights.select(F.col("cluster").alias(c), F.col("rep").alias(r), F.col("weight").alias(w)) for c, r, w in (("c1", "rep", "w1"), ("c2", "__rep", "w2")))
    num = w1.join(pairs, "c1").alias("x").join(w2.alias("y"), (F.col("x.c2") == F.col("y.c2")) & (F.col("rep") == F.col("__rep")))
    num = num.groupBy("rep").agg(F.sum(F.col("twice") * F.col("w1") * F.col("w2")).alias("twice"))
    den = counts.join(weights, "cluster").groupBy("rep").agg(F.sum(F.col("p") * F.col("weight")).alias("p"), F.sum(F.col("q") * F.col("weight")).alias("q"))
    value = F.when((F.col("p") == 0) | (F.col("q") == 0), 0.5).otherwise(F.try_divide(F.coalesce("twice", F.lit(0)).cast("double"), 2.0 * F.col("p") * F.col("q")))
    return den.join(num, "rep", "left").select("rep", value.alias("auc"))


def interval(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """``by..., lo, hi, n_boot`` by linear percentiles; undefined resamples are left out."""
    q = (1 - level) / 2
    return df.groupBy(*by).agg(F.percentile(value, q).alias("lo"), F.percentile(value, 1 - q).alias("hi"), F.count(value).alias("n_boot"))
