"""Rank and effort metrics.  Each takes ``by``, a list of grouping columns, so that metrics per cluster, predictor,
resample or window are one plan.

Running sums are the core.  A window over a whole group would put a large group in one task, so ``running`` cuts the
full order of all groups into ranges of about the same number of rows, sums inside a group's part of a range, and adds
the totals of its parts before.  Metrics that depend on a score alone are first summed for each distinct score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.functions.special import correlation_p
from hornbeam.sources.store import written


def safe(by: list[str], other: list[str]) -> Column:
    """A null-safe join condition on ``by`` against columns renamed to ``other``."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(by, other)), F.lit(True))


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], own: bool = True) -> DataFrame:
    """Adds for each ``{name: column}`` the sum of ``column`` up to and with the row, within its group, or without ``own`` up to
    the row before, 0 for the first.  Rows that agree in all of ``order`` get sums in an arbitrary order.

    The ranges are as many as ``spark.sql.shuffle.partitions``, so their number follows the input, and neither a large
    group nor many rows with one score make a large range.  Rows are written once with their range: drawn again, the
    borders of the ranges would be others.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(ranges, *(F.col(c) for c in by), *order).withColumn("__b", F.spark_partition_id()), "running")
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    upto = (lambda c: F.sum(c).over(inner)) if own else (lambda c: F.coalesce(F.sum(c).over(inner), F.lit(0)))
    out = placed.select("*", *(upto(c).alias(f"__in_{n}") for n, c in sums.items()))
    totals = placed.groupBy(*by, "__b").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    keys = [f"__k{i}" for i in range(len(by))]
    totals = totals.select(
        *(F.col(c).alias(k) for c, k in zip(by, keys)), F.col("__b").alias("__kb"), *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums)
    )
    joined = out.join(totals, safe([*by, "__b"], [*keys, "__kb"]))
    return joined.select(*(F.col(c) for c in df.columns), *((F.col(f"__in_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums))


def running_low(df: DataFrame, by: list[str], order: list[Column], step: str, level: str, low: str, low_before: str) -> DataFrame:
    """Adds the running sum ``level`` of ``step`` within the group, the least that it has been up to and with the row, and up to
    the row before (null for a group's first row).

    Like :func:`running`, with one more number for a group's part of a range: a part moves the level by its sum, and its
    own low counts from the level at its beginning.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(ranges, *(F.col(c) for c in by), *order).withColumn("__b", F.spark_partition_id()), "running")
    part = Window.partitionBy(*by, "__b").orderBy(*order)
    upto, before = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("__level", F.sum(step).over(upto))
    inner = inner.withColumn("__low", F.min("__level").over(upto)).withColumn("__was", F.min("__level").over(before))
    parts = inner.groupBy(*by, "__b").agg(F.sum(step).alias("__sum"), F.min("__level").alias("__least"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.withColumn("__from", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    parts = parts.withColumn("__since", F.min(F.col("__from") + F.col("__least")).over(earlier))
    keys = [f"__k{i}" for i in range(len(by))]
    parts = parts.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col("__b").alias("__kb"), "__from", "__since")
    out = inner.join(parts, safe([*by, "__b"], [*keys, "__kb"]))
    at = lambda x: F.least("__since", F.col("__from") + F.col(x))  # noqa: E731  of what is not null
    return out.select(*(F.col(c) for c in df.columns), (F.col("__from") + F.col("__level")).alias(level), at("__low").alias(low), at("__was").alias(low_before))


def midranks(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds ``name``: twice the average rank of ``column`` within the group, an integer."""
    return several_midranks(df, [(by, column, name)])


def several_midranks(df: DataFrame, wanted: list[tuple[list[str], str, str]]) -> DataFrame:
    """Adds a doubled midrank for each (by, column, name).  Every table of ranks is made from ``df`` itself, one beside
    the other: made one upon the other, their plans would multiply."""
    out = df
    for by, column, name in wanted:
        counts = df.groupBy(*by, column).agg(F.count("*").alias("__n"))
        ranked = running(counts, by, [F.col(column)], {"__upto": "__n"})
        keys = [f"__r{i}" for i in range(len(by) + 1)]
        table = ranked.select(*(F.col(c).alias(k) for c, k in zip([*by, column], keys)), (2 * F.col("__upto") - F.col("__n") + 1).alias(name))
        out = out.join(table, safe([*by, column], keys)).drop(*keys)
    return out


def column(x: Column | str) -> Column:
    """A column, or an SQL expression for one."""
    return F.expr(x) if isinstance(x, str) else x


def auc(df: DataFrame, by: list[str], risk: Column | str, positive: Column | str, degenerate: float | None = 0.5, weight: Column | None = None) -> DataFrame:
    """``by..., n, n_pos, auc``: the share of (positive, negative) pairs in order, ties half.

    With one class only the value is ``degenerate``.  ``weight`` counts a row several times.
    """
    risk, positive = column(risk), column(positive)
    w = F.lit(1).cast("long") if weight is None else weight
    per = df.groupBy(*by, risk.alias("__risk")).agg(F.sum(F.when(positive, w).otherwise(0)).alias("__p"), F.sum(F.when(positive, F.lit(0)).otherwise(w)).alias("__q"))
    run = running(per, by, [F.col("__risk")], {"__neg": "__q"})
    twice = F.sum(F.col("__p") * (2 * F.col("__neg") - F.col("__q")))
    p, q = F.sum("__p"), F.sum("__q")
    value = F.when((p == 0) | (q == 0), F.lit(degenerate)).otherwise(F.try_divide(twice.cast("double"), 2.0 * p * q))
    return run.groupBy(*by).agg((p + q).alias("n"), p.alias("n_pos"), value.cast("double").alias("auc"))


def roc_curve(df: DataFrame, by: list[str], risk: Column | str, positive: Column | str) -> DataFrame:
    """``by..., threshold, tpr, fpr`` after each distinct risk, from the riskiest; the origin has a null threshold."""
    risk, positive = column(risk), column(positive)
    per = df.groupBy(*by, risk.alias("threshold")).agg(F.count_if(positive).alias("__p"), F.count_if(~positive).alias("__q"))
    run = running(per, by, [F.col("threshold").desc()], {"__tp": "__p", "__fp": "__q"})
    total = df.groupBy(*by).agg(F.count_if(positive).alias("__np"), F.count_if(~positive).alias("__nq"))
    keys = [f"__k{i}" for i in range(len(by))]
    total = total.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "__np", "__nq")
    points = run.join(total, safe(by, keys)) if by else run.crossJoin(F.broadcast(total))
    points = points.select(*by, "threshold", F.try_divide("__tp", "__np").alias("tpr"), F.try_divide("__fp", "__nq").alias("fpr"))
    origin = total.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(origin)


def _area(df: DataFrame, by: list[str], order: list[Column], size: str, defects: str) -> DataFrame:
    """``by..., area`` times 2 * total size * total defects, an exact sum: the cumulative curve by trapezoids."""
    run = running(df, by, order, {"__d": defects})
    return run.groupBy(*by).agg(
        F.sum((F.col(size) * (2 * F.col("__d") - F.col(defects))).cast("decimal(38,0)")).alias("area"), F.sum(size).alias("w"), F.sum(defects).alias("d"), F.count("*").alias("n")
    )


def floored(df: DataFrame, size: str) -> DataFrame:
    return df.withColumn(size, F.greatest(F.col(size), F.lit(1)))


def _narrow(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Only what a metric over an order reads, sizes 1 at least; written once, as several orders are made of it."""
    _, size, _ = columns
    return written(floored(df.select(*dict.fromkeys([*by, *columns, "ord"])), size), "units")


def popt(df: DataFrame, by: list[str], score: str, size: str = "size", defects: str = "defects", size_tie: bool = True) -> DataFrame:
    """``by..., n, area_model, area_optimal, area_worst, popt``: low scores are inspected first, ties by size, then ``ord``.

    Null without a defect or with fewer than 3 rows; 0.5 where best and worst order are alike.  The worst curve is the
    best one reversed, so its area is what the best one's is short of 1.
    """
    d = _narrow(df, by, score, size, defects).withColumn("__density", F.col(defects) / F.col(size))
    model = [F.col(score), *([F.col(size)] if size_tie else []), F.col("ord")]
    a = _area(d, by, model, size, defects)
    b = _area(d, by, [F.col("__density").desc(), F.col("ord")], size, defects)
    keys = [f"__k{i}" for i in range(len(by))]
    b = b.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col("area").alias("best"))
    both = a.join(b, safe(by, keys)) if by else a.crossJoin(F.broadcast(b))
    whole = 2.0 * F.col("w") * F.col("d")
    model_area, best = F.try_divide(F.col("area").cast("double"), whole), F.try_divide(F.col("best").cast("double"), whole)
    out = both.select(*by, "n", "d", model_area.alias("area_model"), best.alias("area_optimal"), (1 - best).alias("area_worst"))
    gap = F.col("area_optimal") - F.col("area_worst")
    value = F.when((F.col("d") == 0) | (F.col("n") < 3), None).when(gap == 0, 0.5).otherwise(1 - (F.col("area_optimal") - F.col("area_model")) / gap)
    return out.withColumn("popt", value).drop("d")


def alberg_curve(df: DataFrame, by: list[str], score: str, size: str = "size", defects: str = "defects") -> DataFrame:
    """``by..., ord, size_share, defect_share`` along the model's order."""
    d = _narrow(df, by, score, size, defects)
    run = running(d, by, [F.col(score), F.col(size), F.col("ord")], {"__w": size, "__d": defects})
    keys = [f"__k{i}" for i in range(len(by))]
    total = d.groupBy(*by).agg(F.sum(size).alias("__tw"), F.sum(defects).alias("__td"))
    total = total.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "__tw", "__td")
    both = run.join(total, safe(by, keys)) if by else run.crossJoin(F.broadcast(total))
    return both.select(*by, "ord", F.try_divide("__w", "__tw").alias("size_share"), F.try_divide("__d", "__td").alias("defect_share"))


def effort(df: DataFrame, by: list[str], score: str, share: float = 0.2, size: str = "size", defects: str = "defects") -> DataFrame:
    """``by..., files, inspected, precision, recall_defects, recall_files`` of the files that fit a share of all size.

    The first file is always inspected; the walk ends at the first that does not fit.  Sizes are at least 1, so running
    sums rise and the walk is a filter.
    """
    d = _narrow(df, by, score, size, defects)
    run = running(d, by, [F.col(score), F.col(size), F.col("ord")], {"__w": size})
    keys = [f"__k{i}" for i in range(len(by))]
    total = d.groupBy(*by).agg(F.sum(size).alias("__tw"), F.sum(defects).alias("__td"), F.count_if(F.col(defects) > 0).alias("__tp"))
    total = total.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), "__tw", "__td", "__tp")
    both = run.join(total, safe(by, keys)) if by else run.crossJoin(F.broadcast(total))
    taken = both.where((F.col("__w") <= share * F.col("__tw")) | (F.col("__w") == F.col(size)))
    return taken.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.sum(size).alias("inspected"),
        F.try_divide(F.count_if(F.col(defects) > 0), F.count("*")).alias("precision"),
        F.coalesce(F.try_divide(F.sum(defects), F.max("__td")), F.lit(0.0)).alias("recall_defects"),
        F.coalesce(F.try_divide(F.count_if(F.col(defects) > 0), F.max("__tp")), F.lit(0.0)).alias("recall_files"),
    )


def precision_at_k(df: DataFrame, score: str, k: int, defects: str = "defects") -> DataFrame:
    """``k, hits, precision`` over the ``k`` lowest scores, ties by ``ord``; ``k`` is capped by the number of rows."""
    lowest = df.orderBy(score, "ord").limit(k)
    return lowest.agg(F.count("*").alias("k"), F.count_if(F.col(defects) > 0).alias("hits")).withColumn("precision", F.try_divide("hits", "k"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by..., n, rho, p``, p two-sided by the t distribution; null below 3 rows or where either side is constant."""
    ranked = several_midranks(df, [(by, x, "__rx"), (by, y, "__ry")])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), _corr("__rx", "__ry").alias("rho")).withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), _corr(x, y).alias("r"))


def _corr(x: str, y: str) -> Column:
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count("*") < 3)
    # corr() itself raises on a constant column
    return F.when(flat, None).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def partial_spearman(df: DataFrame, by: list[str], x: str, y: str, given: str) -> DataFrame:
    """``by..., n, rho_xy, rho_xz, rho_yz, partial``: the rank correlation of x and y with that of ``given`` taken out."""
    ranked = several_midranks(df, [(by, x, "__x"), (by, y, "__y"), (by, given, "__z")])
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), _corr("__x", "__y").alias("rho_xy"), _corr("__x", "__z").alias("rho_xz"), _corr("__y", "__z").alias("rho_yz"))
    den = F.sqrt((1 - F.col("rho_xz") ** 2) * (1 - F.col("rho_yz") ** 2))
    part = F.when(den == 0, 0.0).otherwise((F.col("rho_xy") - F.col("rho_xz") * F.col("rho_yz")) / den)
    return out.withColumn("partial", part)
