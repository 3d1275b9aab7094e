"""Registered queries on models; what DuckDB can say of them (folds, feature tables) has an equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import changes as C
from hornbeam.operators import groups as G
from hornbeam.operators import models as M
from hornbeam.operators import ranking as R
from hornbeam.plans.group_queries import ROSTER, WF
from hornbeam.plans.rank_queries import POSITIVE, _rounded
from hornbeam.sources.store import discard, written
from hornbeam.sources.tables import commit_files, commits, findings, read, units


def feature_matrix(spark, d):
    """Severity-weighted findings of each kind and log size, a column each; kinds that never occur are 0."""
    per = findings(spark, d).groupBy("unit_id", "biomarker").agg(F.sum(G.severity_weight(F.col("severity"))).alias("w"))
    wide = per.groupBy("unit_id").agg(*(F.max(F.when(F.col("biomarker") == b, F.col("w"))).alias(f"f_{b}") for b in ROSTER))
    names = [f"f_{b}" for b in ROSTER]
    out = units(spark, d).select("unit_id", "stratum", "defects", F.log1p("size").alias("log_size")).join(wide, "unit_id", "left").fillna(0, names)
    return _rounded(out, "log_size")


def magnitude_matrix(spark, d):
    """Log of the greatest magnitude of each kind where one is known, else whether it occurs."""
    per = findings(spark, d).groupBy("unit_id", "biomarker").agg(F.max(F.when(F.col("magnitude") > 0.02, F.col("magnitude"))).alias("m"))
    value = F.coalesce(F.log1p("m"), F.lit(1.0))
    wide = per.groupBy("unit_id").agg(*(F.max(F.when(F.col("biomarker") == b, value)).alias(f"m_{b}") for b in ROSTER))
    names = [f"m_{b}" for b in ROSTER]
    return _rounded(units(spark, d).select("unit_id").join(wide, "unit_id", "left").fillna(0.0, names), *names)


def lr_grouped_oof(spark, d):
    """AUC of a leave-one-stratum-out model, pooled and by stratum."""
    x = feature_matrix(spark, d).withColumn("y", F.expr("cast(defects > 0 as int)"))
    p = M.out_of_fold(x, "stratum", ["log_size", *(f"f_{b}" for b in ROSTER)], "y")
    both = p.unionByName(p.withColumn("stratum", F.lit("all")))
    return _rounded(R.auc(both, ["stratum"], F.round("p", 9), POSITIVE), "auc")


def ck_folds(spark, d):
    """Sizes of ten folds dealt round-robin within each class."""
    u = units(spark, d).withColumn("y", F.expr("cast(defects > 1 as int)"))
    return M.folds(u.select("unit_id", "y"), "y", "unit_id").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.sum("unit_id").alias("ids"))


def ck_oof(spark, d):
    """Ten-fold model on size and scores, unbalanced."""
    u = units(spark, d).withColumn("y", F.expr("cast(defects > 1 as int)"))
    x = M.folds(u.select("unit_id", "y", "score", "rival", F.log1p("size").alias("log_size"), "defects"), "y", "unit_id")
    p = M.out_of_fold(x, "fold", ["score", "rival", "log_size"], "y", balanced=False)
    return _rounded(R.auc(p, [], F.round("p", 9), "y = 1"), "auc")


def jit_oof(spark, d):
    """Change model: the first 70 % of time train, the rest test."""
    f = C.features(commit_files(spark, d)).join(C.experience(commits(spark, d)), "sha")
    names = ["la", "ld", "nf", "nd", "ns", "exp"]
    f = f.select("sha", "ct", "entropy", (F.col("priority") == "1-URGENT").cast("int").alias("y"), *(F.log1p(c).alias(c) for c in names))
    s = written(C.time_split(written(f, "changes")), "changes")  # the split reads them three times, the fit in every step
    model = M.fit(s.where("train"), ["entropy", *names], "y", keep=False)
    out = R.auc(M.predict(s.where(~F.col("train")), ["entropy", *names], model), [], F.round("p", 9), "y = 1")
    return _rounded(out, "auc")


def jit_constants(spark, d):
    """Mean, deviation and coefficient of each feature of the pooled change model, and its offset."""
    logs = ["la", "ld", "nf", "nd", "ns", "exp"]
    f = C.features(commit_files(spark, d)).join(C.experience(commits(spark, d)), "sha")
    f = f.select((F.col("priority") == "1-URGENT").cast("int").alias("y"), "entropy", *(F.log1p(c).alias(c) for c in logs))
    names = ["entropy", *logs]
    weights, offset, scale = M.fit(f, names, "y")
    rows = [(n, round(scale[n][0], 6), round(scale[n][1], 6), round(w, 6)) for n, w in zip(names, weights)] + [("offset", 0.0, 1.0, round(offset, 6))]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double, coefficient double")


MIXED = ["size_log", *(f"f_{b}" for b in ROSTER if b != "XX")]


def _mixed(spark, d):
    """Defective units by their findings and size, with an intercept for each cluster (repository) or stratum (language): the
    names of the groups and their models.  What both are fitted to is made and written once."""
    f = feature_matrix(spark, d).join(read(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("cluster")), "unit_id")
    f = f.withColumn("family", F.substring_index("stratum", " ", 1)).withColumnRenamed("log_size", "size_log").withColumn("y", F.expr("defects > 1").cast("int"))
    f = written(f.select("y", "cluster", "family", *MIXED), "mixed")
    for group in ("cluster", "family"):
        yield group, M.mixed(f, MIXED, "y", group)
    discard(f)


def random_intercept(spark, d):
    """Fixed effects and the deviation of the intercepts by cluster and by family of strata."""
    rows = []
    for group, m in _mixed(spark, d):
        rows += [(group, k, round(v, 5)) for k, v in (*m.fixed.items(), ("sd", m.sd))]
    return spark.createDataFrame(rows, "model string, effect string, value double")


def mixed_slopes(spark, d):
    """Slopes of the mixed model's objective at its effects, all of which have to be 0."""
    out = None
    for group, m in _mixed(spark, d):
        one = M.slopes(m).select(F.lit(group).alias("model"), "effect", (F.abs("slope") < 1e-2).alias("flat"))
        out = one if out is None else out.unionByName(one)
    return out


_W = "case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 1 end"
SQL = {
    "mixed_slopes": "select model, effect, true as flat from (values ('cluster'), ('family')) a(model), (select unnest(['intercept', " + ", ".join(f"'{x}'" for x in MIXED) + ", 'groups', 'variance']) as effect)",
    "feature_matrix": WF + "w as (select unit_id, " + ", ".join(f"sum({_W}) filter (biomarker = '{b}') as f_{b}" for b in ROSTER) + " from f group by 1) select u.unit_id, stratum, defects, round(ln(1 + size::double), 6) as log_size, "
    + ", ".join(f"coalesce(f_{b}, 0)::bigint as f_{b}" for b in ROSTER) + " from u left join w on w.unit_id = u.unit_id",
    "magnitude_matrix": WF + "w as (select unit_id, " + ", ".join(f"case when count(*) filter (biomarker = '{b}') = 0 then 0.0 else coalesce(ln(1 + max(magnitude) filter (biomarker = '{b}' and magnitude > 0.02)), 1.0) end as m_{b}" for b in ROSTER)
    + " from f group by 1) select u.unit_id, " + ", ".join(f"round(coalesce(m_{b}, 0), 6) as m_{b}" for b in ROSTER) + " from u left join w on w.unit_id = u.unit_id",
    "ck_folds": WF + "x as (select unit_id, (defects > 1)::int as y, (row_number() over (partition by (defects > 1)::int order by ('0x' || substr(md5('7|' || unit_id), 1, 12))::bigint, unit_id) - 1) % 10 as fold from u) select fold::int as fold, count(*) as n, sum(y)::bigint as positives, sum(unit_id)::bigint as ids from x group by 1",
}

QUERIES = {f.__name__: f for f in (feature_matrix, magnitude_matrix, lr_grouped_oof, ck_folds, ck_oof, jit_oof, jit_constants, random_intercept, mixed_slopes)}
