"""Grouped statistics: densities, bands, effect sizes and rank tests on already summed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.functions.special import chi_square_tail, exact_u_tail, normal_tail
from hornbeam.operators import ranking as R
from hornbeam.sources.store import written

#: Weight of a finding's severity; any other counts 1.
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_weight(severity: Column) -> Column:
    out = F.lit(1)
    for name, w in SEVERITY.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def density_ratio(df: DataFrame, by: list[str], low: float = 5.0, high: float = 8.0) -> DataFrame:
    """Mean defects and defects per 1000 lines of rows that score below ``low`` and above ``high``; the ratio of the means,
    and ``per_k_ratio``, that of the densities.

    A high side of 0 makes a ratio infinite, no rows on a side make its mean 0; no lines make a density 0.
    """
    low, high = F.col("score") < low, F.col("score") > high
    part = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    out = df.groupBy(*by).agg(
        F.count_if(low).alias("low_n"), F.count_if(high).alias("high_n"),
        F.coalesce(F.try_divide(part(low, "defects"), F.count_if(low)), F.lit(0.0)).alias("low_mean"),
        F.coalesce(F.try_divide(part(high, "defects"), F.count_if(high)), F.lit(0.0)).alias("high_mean"),
        F.coalesce(F.try_divide(1000 * part(low, "defects"), part(low, "size")), F.lit(0.0)).alias("low_per_k"),
        F.coalesce(F.try_divide(1000 * part(high, "defects"), part(high, "size")), F.lit(0.0)).alias("high_per_k"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(float("inf"))).otherwise(F.try_divide(a, b))
    return out.withColumn("ratio", ratio("low_mean", "high_mean")).withColumn("per_k_ratio", ratio("low_per_k", "high_per_k"))


def density_by_bucket(df: DataFrame, edges: tuple[float, ...] = (0, 4, 6, 8, 10)) -> DataFrame:
    """Files, defects, mean and density of score buckets [lo, hi), the last one closed; empty buckets are rows too."""
    spark = df.sparkSession
    n = len(edges) - 1
    rows = [(i, f"[{edges[i]:.0f}-{edges[i + 1]:.0f}" + ("]" if i == n - 1 else ")")) for i in range(n)]
    at = F.lit(None).cast("int")
    for i in range(n):
        upper = F.col("score") <= edges[i + 1] if i == n - 1 else F.col("score") < edges[i + 1]
        at = F.when((F.col("score") >= edges[i]) & upper, i).otherwise(at)
    sums = df.groupBy(at.alias("at")).agg(F.count("*").alias("files"), F.sum("defects").alias("defects"), F.sum("size").alias("size"))
    out = spark.createDataFrame(rows, "at int, bucket string").join(sums, "at", "left").fillna(0, ["files", "defects", "size"])
    zero = F.lit(0.0)
    return out.select(
        "bucket", "files", "defects", F.coalesce(F.try_divide("defects", "files"), zero).alias("mean_defects"), F.coalesce(F.try_divide(1000 * F.col("defects"), "size"), zero).alias("per_k")
    )


def category(score: Column) -> Column:
    return F.when(score >= 8, "healthy").when(score < 4, "alert").otherwise("warning")


def category_stats(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, category(F.col("score")).alias("category")).agg(
        F.count("*").alias("files"), F.try_divide(F.sum("defects"), F.count("*")).alias("mean_defects"), F.coalesce(F.try_divide(1000 * F.sum("defects"), F.sum("size")), F.lit(0.0)).alias("per_k")
    )


def descriptive(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Counts, mean, median, extremes, sample deviation and sum; the deviation of one row is 0."""
    c = F.col(column)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(c > 0).alias("n_positive"), (100 * F.try_divide(F.count_if(c == 0), F.count("*"))).alias("pct_zero"),
        F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.sum(c).alias("sum"),
    )


def kruskal(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """``by..., groups, h, p``: tie-corrected Kruskal-Wallis, p from the chi-square distribution with one degree of freedom less
    than there are groups; null with fewer than two groups or all values alike."""
    per = df.groupBy(*by, group.alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    values = per.groupBy(*by, "__v").agg(F.sum("__n").alias("__t"))
    ranked = R.running(values, by, [F.col("__v")], {"__upto": "__t"})
    keys = [f"__k{i}" for i in range(len(by) + 1)]
    ranked = ranked.select(*(F.col(c).alias(k) for c, k in zip([*by, "__v"], keys)), (2 * F.col("__upto") - F.col("__t") + 1).alias("__r2"), "__t")
    joined = per.join(ranked, R.safe([*by, "__v"], keys)).drop(*keys)
    sums = joined.groupBy(*by, "__g").agg(F.sum(F.col("__r2") * F.col("__n")).alias("__s"), F.sum("__n").alias("__m"))
    n, k = F.sum("__m"), F.count("*")
    spread = F.sum(F.col("__s").cast("double") * F.col("__s") / 4 / F.col("__m"))
    out = sums.groupBy(*by).agg(n.alias("__total"), k.alias("groups"), (12.0 / (n * (n + 1)) * spread - 3 * (n + 1)).alias("__h"))
    ties = values.groupBy(*by).agg(F.sum(F.col("__t") ** 3 - F.col("__t")).alias("__ties"))
    keys = [f"__k{i}" for i in range(len(by))]
    ties = ties.select(*(F.col(c).alias(x) for c, x in zip(by, keys)), "__ties")
    both = out.join(ties, R.safe(by, keys)) if by else out.crossJoin(F.broadcast(ties))
    total = F.col("__total").cast("double")
    fix = 1 - F.col("__ties") / (total**3 - total)
    h = F.when((F.col("groups") < 2) | (fix <= 0), None).otherwise(F.col("__h") / fix)
    return both.select(*by, "groups", h.alias("h")).withColumn("p", chi_square_tail(F.col("h"), F.col("groups") - 1))


def with_without(df: DataFrame, marks: DataFrame, roster: list[str], value: str) -> DataFrame:
    """``biomarker, n_with, n_without, mean_with, mean_without, u, delta, z``: Mann-Whitney and Cliff's delta for each.

    ``marks(unit_id, biomarker)`` says which units have it.  Units are summed by value first; the units without a
    biomarker are all less those with it, so nothing is multiplied by the roster.  ``u`` counts pairs in which the one
    with it is greater, ties half; delta is ``2 u / (n m) - 1``, and 0 where a side is empty; ``u`` and ``z`` (normal,
    tie and continuity corrected) need 3 on both sides.
    """
    spark = df.sparkSession
    total = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("t"))
    has = marks.select("unit_id", "biomarker").distinct().join(df.select("unit_id", F.col(value).alias("v")), "unit_id")
    has = has.groupBy("biomarker", "v").agg(F.count("*").alias("a"))
    names = spark.createDataFrame([(x,) for x in roster], "biomarker string")
    grid = names.crossJoin(total).join(has, ["biomarker", "v"], "left").fillna(0, ["a"])  # roster times distinct values
    grid = grid.withColumn("b", F.col("t") - F.col("a"))
    w = Window.partitionBy("biomarker").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("below", F.sum("b").over(w))
    n, m = F.sum("a"), F.sum("b")
    out = grid.groupBy("biomarker").agg(
        n.alias("n_with"), m.alias("n_without"),
        F.coalesce(F.try_divide(F.sum(F.col("a") * F.col("v")), n), F.lit(0.0)).alias("mean_with"),
        F.coalesce(F.try_divide(F.sum(F.col("b") * F.col("v")), m), F.lit(0.0)).alias("mean_without"),
        F.sum(F.col("a") * (2 * F.col("below") - F.col("b"))).alias("u2"),
        F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"),
    )
    a, b = F.col("n_with").cast("double"), F.col("n_without").cast("double")
    enough = (a >= 3) & (b >= 3)
    u = F.col("u2") / 2
    var = a * b / 12 * ((a + b + 1) - F.col("ties") / ((a + b) * (a + b - 1)))
    return out.select(
        "biomarker", "n_with", "n_without", "mean_with", "mean_without",
        F.when(enough, u).alias("u"),
        F.when((a == 0) | (b == 0), 0.0).otherwise(2 * u / (a * b) - 1).alias("delta"),
        F.when(enough & (var > 0), (u - a * b / 2 - 0.5) / F.sqrt(var)).alias("z"),
    )


def mann_whitney(df: DataFrame, by: list[str], first: Column | str, value: str, least: int = 3, small: int = 8) -> DataFrame:
    """``by..., n, m, u, exact, p``: rows with ``first`` against the others of their group, alternative "greater".

    ``u`` counts pairs in which the first is greater, ties half.  With at most ``small`` rows on the smaller side and no ties
    p comes from the exact distribution, else from the normal one with tie and continuity correction; it is null where
    that has no spread, and all is null below ``least`` rows on a side.  Rows without a value do not count; a null ``first``
    is a no.
    """
    is_first = F.coalesce(R.column(first), F.lit(False))
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count_if(is_first).alias("__ours"), F.count_if(~is_first).alias("__theirs"))
    run = R.running(per, by, [F.col("__v")], {"__below": "__theirs"})
    t = F.col("__ours") + F.col("__theirs")
    sums = run.groupBy(*by).agg(
        F.sum("__ours").alias("n"), F.sum("__theirs").alias("m"), F.sum(F.col("__ours") * (2 * F.col("__below") - F.col("__theirs"))).alias("__u2"), F.sum(t**3 - t).alias("__ties"),
    )
    n, m, u = F.col("n").cast("double"), F.col("m").cast("double"), F.col("__u2") / 2
    exact = (F.least("n", "m") <= small) & (F.col("__ties") == 0)
    var = n * m / 12 * ((n + m + 1) - F.col("__ties") / ((n + m) * (n + m - 1)))
    p = F.when(exact, exact_u_tail(u, F.when(exact, F.col("n")), F.col("m"))).when(var > 0, normal_tail((u - n * m / 2 - 0.5) / F.sqrt(var)))
    enough = F.least("n", "m") >= least
    return sums.select(*by, "n", "m", F.when(enough, u).alias("u"), F.when(enough, exact).alias("exact"), F.when(enough, p).alias("p"))


def dominant(findings: DataFrame) -> DataFrame:
    """``unit_id, weighted, impact, findings, dominant``: severity-weighted count, summed impact, and the biomarker with
    most impact, of equals the one met first."""
    per = findings.groupBy("unit_id", "biomarker").agg(
        F.sum(severity_weight(F.col("severity"))).alias("w"), F.sum(F.abs("impact")).alias("imp"), F.min("ord").alias("first"), F.count("*").alias("c")
    )
    return per.groupBy("unit_id").agg(
        F.sum("w").alias("weighted"), F.sum("imp").alias("impact"), F.sum("c").alias("findings"),
        F.max_by("biomarker", F.struct(F.round("imp", 9), -F.col("first"))).alias("dominant"),
    )


def bands(df: DataFrame, column: str = "size") -> DataFrame:
    """Adds ``band`` Q1..Q4 by the exact linear quartiles of all rows; a value on a cut is in the lower band."""
    cuts = df.agg(*(F.percentile(column, q).alias(f"__q{i}") for i, q in enumerate((0.25, 0.5, 0.75), 1)))
    c = F.col(column)
    band = F.when(c <= F.col("__q1"), "Q1").when(c <= F.col("__q2"), "Q2").when(c <= F.col("__q3"), "Q3").otherwise("Q4")
    return df.crossJoin(F.broadcast(cuts)).withColumn("band", band).drop("__q1", "__q2", "__q3")


def standardised(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds the z-score within ``by``; 0 where the population deviation is nil.  Two numbers a group are joined back,
    so no group is gathered."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    keys = [f"__k{i}" for i in range(len(by))]
    stats = stats.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "__m", "__s")
    z = F.when(F.col("__s") <= 1e-9, 0.0).otherwise((F.col(column) - F.col("__m")) / F.col("__s"))
    return df.join(stats, R.safe(by, keys)).withColumn(name, z).drop(*keys, "__m", "__s")


def residual(df: DataFrame, by: list[str], y: Column | str, x: Column | str, name: str) -> DataFrame:
    """Adds what is left of ``y`` after a least-squares line on ``x``; ``y`` itself where x or y hardly vary."""
    d = df.withColumn("__y", R.column(y)).withColumn("__x", R.column(x))
    fit = d.groupBy(*by).agg(F.regr_slope("__y", "__x").alias("__a"), F.regr_intercept("__y", "__x").alias("__b"), F.stddev_pop("__x").alias("__sx"), F.stddev_pop("__y").alias("__sy"))
    keys = [f"__k{i}" for i in range(len(by))]
    fit = fit.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "__a", "__b", "__sx", "__sy")
    both = d.join(fit, R.safe(by, keys)) if by else d.crossJoin(F.broadcast(fit))
    flat = (F.col("__sx") < 1e-9) | (F.col("__sy") < 1e-9)
    value = F.when(flat, F.col("__y")).otherwise(F.col("__y") - F.col("__a") * F.col("__x") - F.col("__b"))
    return both.withColumn(name, value).drop(*keys, "__x", "__y", "__a", "__b", "__sx", "__sy")


def leave_out_auc(df: DataFrame, cluster: str, risk: Column | str, positive: Column | str) -> DataFrame:
    """``cluster, n, positives, auc_within, auc_without``: the metric of each cluster and of all the others together.

    Counts are summed by distinct risk.  What a cluster takes away from the total's area is a sum over its own risks alone:
    its positives against all negatives, all positives against its negatives, less its own against its own.  So nothing is
    multiplied by clusters, and risks may be as many as rows.
    """
    risk, positive = R.column(risk), R.column(positive)
    own = written(df.groupBy(cluster, risk.alias("r")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q")), "risks")
    total = own.groupBy("r").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    total = written(R.running(total, [], [F.col("r")], {"upto_p": "tp", "upto_q": "tq"}), "risks-total")
    wide = lambda x: x.cast("decimal(38,0)")
    whole = total.agg(F.sum("tp").alias("all_p"), F.sum("tq").alias("all_q"), F.sum(wide(F.col("tp") * (2 * F.col("upto_q") - F.col("tq")))).alias("area"))
    rows = R.running(own, [cluster], [F.col("r")], {"uq": "q"}).join(total.withColumnRenamed("r", "__r"), F.col("r").eqNullSafe(F.col("__r"))).crossJoin(F.broadcast(whole))
    mine = F.sum(wide(F.col("p") * (2 * F.col("uq") - F.col("q"))))
    ours = F.sum(wide(F.col("p") * (2 * F.col("upto_q") - F.col("tq"))))
    theirs = F.sum(wide(F.col("q") * (2 * (F.col("all_p") - F.col("upto_p")) + F.col("tp"))))
    p, q, most = F.sum("p"), F.sum("q"), F.max
    without = most("area") - ours - theirs + mine
    return rows.groupBy(cluster).agg(
        (p + q).alias("n"), p.alias("positives"), F.try_divide(mine.cast("double"), 2.0 * p * q).alias("auc_within"),
        F.try_divide(without.cast("double"), 2.0 * (most("all_p") - p) * (most("all_q") - q)).alias("auc_without"),
    )
