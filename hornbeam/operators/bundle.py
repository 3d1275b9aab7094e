"""Every per-file metric of a group from one order.

Files are put once into the model's order (score, size, input order), cut into ranges, with running sums of size, defects,
negatives and rows.  All that depends on the order is then an aggregate over each distinct score, and every metric a sum
over these: AUC, rank correlations, Kruskal-Wallis, densities, effort within a share of all size, the area of the effort curve,
the lowest k.  Ranks of defects and size are joined to the files before; only the best possible curve needs a second order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.special import chi_square_tail, correlation_p
from hornbeam.operators import ranking as R
from hornbeam.sources.store import written


def metric_bundle(df: DataFrame, by: list[str], k: int = 20, share: float = 0.2, low: float = 5.0, high: float = 8.0, least: int = 1) -> DataFrame:
    """``by..., n, n_pos`` and the metrics of ``df(by..., score, size, defects, ord)``, a row for each group:

    ``auc`` (0.5 with one class only); ``rho``, ``rho_p`` of score and defects and ``partial`` with size taken out; ``popt``;
    ``files``, ``inspected``, ``precision``, ``recall_defects``, ``recall_files`` within ``share`` of all size; ``hits_k`` and
    ``precision_k`` of the ``k`` lowest; means and densities below ``low`` and above ``high`` with their ratios; ``kruskal_h`` and
    ``kruskal_p`` over scores from 8, from 4 and below; mean, median, extremes and deviation of defects and of scores.

    Definitions are those of :mod:`ranking` and :mod:`groups`.  With fewer than ``least`` rows or no positive one ``auc`` to
    ``precision_k`` are null.  Sizes count as 1 at least where effort is summed.  Asking for the frame writes the order.
    """
    if not by:
        one = metric_bundle(df.withColumn("__all", F.lit(1)), ["__all"], k, share, low, high, least)
        return one.drop("__all")
    d = df.select(*dict.fromkeys([*by, "score", "size", "defects", "ord"])).withColumn("eff", F.greatest("size", F.lit(1)))
    d = written(d, "units")
    total = d.groupBy(*by).agg(
        F.count("*").alias("t_n"), F.sum("eff").alias("t_w"), F.sum("defects").alias("t_d"), F.count_if(F.col("defects") > 0).alias("t_p"),
        F.avg("defects").alias("defects_mean"), F.min("defects").alias("defects_min"), F.max("defects").alias("defects_max"), F.coalesce(F.stddev_samp("defects"), F.lit(0.0)).alias("defects_std"),
        F.median("defects").alias("defects_median"), F.avg("score").alias("score_mean"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"), F.median("score").alias("score_median"),
    )
    keys = [f"__t{i}" for i in range(len(by))]
    named = lambda t, names: t.select(*(F.col(c).alias(x) for c, x in zip(by, names)), *(c for c in t.columns if c not in by))
    ranked = R.several_midranks(d, [(by, "defects", "ry"), (by, "size", "rz")])
    ranked = ranked.withColumn("one", F.lit(1).cast("long")).withColumn("neg", (F.col("defects") <= 0).cast("long"))
    run = R.running(ranked, by, [F.col("score"), F.col("eff"), F.col("ord")], {"w": "eff", "y": "defects", "q": "neg", "rn": "one"})
    run = run.join(named(total.select(*by, "t_n", "t_w"), keys), R.safe(by, keys)).drop(*keys)
    taken = (F.col("w") <= share * F.col("t_w")) | (F.col("w") == F.col("eff"))
    hit = F.col("defects") > 0
    cy, cz = F.col("ry") - F.col("t_n") - 1.0, F.col("rz") - F.col("t_n") - 1.0
    s = run.groupBy(*by, "score").agg(
        F.count("*").alias("c"), F.count_if(hit).alias("p"), F.max("q").alias("upto"), F.max("rn").alias("rn"), F.sum("defects").alias("d"), F.sum("size").alias("size"),
        F.sum((F.col("eff") * (2 * F.col("y") - F.col("defects"))).cast("decimal(38,0)")).alias("area"),
        F.count_if(taken).alias("files"), F.sum(F.when(taken, F.col("eff"))).alias("inspected"), F.count_if(taken & hit).alias("found"), F.sum(F.when(taken, F.col("defects"))).alias("found_defects"),
        F.count_if(F.col("rn") <= k).alias("k"), F.count_if((F.col("rn") <= k) & hit).alias("hits"),
        F.sum(cy).alias("sy"), F.sum(cz).alias("sz"), F.sum(cy * cy).alias("syy"), F.sum(cz * cz).alias("szz"), F.sum(cy * cz).alias("syz"), F.sum("ry").alias("ranks"),
    )
    s = s.join(named(total.select(*by, "t_n"), keys), R.safe(by, keys)).drop(*keys)
    cx = 2 * F.col("rn") - F.col("c") + 1 - F.col("t_n") - 1.0  # twice the midrank of the score, about its mean
    q = F.col("c") - F.col("p")
    side = lambda cond, x: F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0))
    below, above = F.col("score") < low, F.col("score") > high
    bands = {"g": F.col("score") >= 8, "y": (F.col("score") >= 4) & (F.col("score") < 8), "r": F.col("score") < 4}
    out = s.groupBy(*by).agg(
        # risk falls with the score: a positive row is right of all negative ones with a higher score
        F.sum((F.col("p") * (2 * (F.col("t_n") - F.col("upto")) + q)).cast("decimal(38,0)")).alias("above"), F.sum(F.col("p")).alias("sum_p"), F.sum("area").alias("area"),
        *(F.sum(c).alias(c) for c in ("files", "inspected", "found", "found_defects", "k", "hits", "syy", "szz", "syz")),
        F.sum(cx * cx * F.col("c")).alias("sxx"), F.sum(cx * F.col("sy")).alias("sxy"), F.sum(cx * F.col("sz")).alias("sxz"),
        *(e.alias(n) for n, e in (("low_n", side(below, "c")), ("low_d", side(below, "d")), ("low_size", side(below, "size")), ("high_n", side(above, "c")), ("high_d", side(above, "d")), ("high_size", side(above, "size")))),
        *(e.alias(n) for b, cond in bands.items() for n, e in ((f"{b}_n", side(cond, "c")), (f"{b}_ranks", side(cond, "ranks")))),
    )
    ties = d.groupBy(*by, "defects").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    best = R._area(d.withColumn("__density", F.col("defects") / F.col("eff")), by, [F.col("__density").desc(), F.col("ord")], "eff", "defects").select(*by, F.col("area").alias("best"))
    for i, t in enumerate((total, ties, best)):
        names = [f"__j{i}_{x}" for x in range(len(by))]
        out = out.join(named(t, names), R.safe(by, names)).drop(*names)

    ratio = lambda a, b, none=None: F.coalesce(F.try_divide(a, b), F.lit(none).cast("double"))
    n, p = F.col("t_n"), F.col("t_p")
    m = n - p
    # ``above`` counts negatives above as N less those up to the score, of which P are no negatives
    auc = F.when((p == 0) | (m == 0), 0.5).otherwise(F.try_divide((F.col("above") - 2 * p * p).cast("double"), 2.0 * p * m))
    corr = lambda xy, xx, yy: F.when((F.col("t_n") >= 3) & (F.col(xx) > 0) & (F.col(yy) > 0), F.col(xy) / F.sqrt(F.col(xx) * F.col(yy)))
    out = out.withColumns({"auc": auc, "rho": corr("sxy", "sxx", "syy"), "rxz": corr("sxz", "sxx", "szz"), "ryz": corr("syz", "syy", "szz")})
    den = F.sqrt((1 - F.col("rxz") ** 2) * (1 - F.col("ryz") ** 2))
    whole = 2.0 * F.col("t_w") * F.col("t_d")
    o, a = F.try_divide(F.col("best").cast("double"), whole), F.try_divide(F.col("area").cast("double"), whole)
    popt = F.when((F.col("t_d") == 0) | (n < 3), None).when(2 * o - 1 == 0, 0.5).otherwise(1 - (o - a) / (2 * o - 1))
    groups = sum(((F.col(f"{b}_n") > 0).cast("int") for b in bands), F.lit(0))
    spread = sum((F.coalesce(F.try_divide(F.col(f"{b}_ranks").cast("double") * F.col(f"{b}_ranks") / 4, F.col(f"{b}_n")), F.lit(0.0)) for b in bands), F.lit(0.0))
    fix = 1 - F.col("ties") / (n.cast("double") ** 3 - n)
    h = F.when((groups >= 2) & (fix > 0), (12.0 / (n * (n + 1)) * spread - 3 * (n + 1)) / fix)
    known = (n >= least) & ((p > 0) if least > 1 else F.lit(True))
    told = {
        "auc": F.col("auc"), "rho": F.col("rho"), "rho_p": correlation_p(F.col("rho"), n), "partial": F.when(den == 0, 0.0).otherwise((F.col("rho") - F.col("rxz") * F.col("ryz")) / den), "popt": popt,
        "files": F.col("files"), "inspected": F.col("inspected"), "precision": F.try_divide("found", "files"), "recall_defects": ratio(F.col("found_defects"), F.col("t_d"), 0.0), "recall_files": ratio(F.col("found"), p, 0.0),
        "hits_k": F.col("hits"), "precision_k": F.try_divide("hits", "k"),
    }
    infinite = lambda x, y: F.when(y == 0, F.lit(float("inf"))).otherwise(F.try_divide(x, y))
    mean = {b: ratio(F.col(f"{b}_d"), F.col(f"{b}_n"), 0.0) for b in ("low", "high")}
    per_k = {b: ratio(1000 * F.col(f"{b}_d"), F.col(f"{b}_size"), 0.0) for b in ("low", "high")}
    return out.select(
        *by, n.alias("n"), p.alias("n_pos"), *(F.when(known, e).alias(c) for c, e in told.items()),
        mean["low"].alias("low_mean"), mean["high"].alias("high_mean"), infinite(mean["low"], mean["high"]).alias("ratio"),
        per_k["low"].alias("low_per_k"), per_k["high"].alias("high_per_k"), infinite(per_k["low"], per_k["high"]).alias("per_k_ratio"),
        h.alias("kruskal_h"), chi_square_tail(h, groups - 1).alias("kruskal_p"),
        *(F.col(f"{x}_{c}") for x in ("defects", "score") for c in ("mean", "median", "min", "max", "std")),
    )
