"""Registered ranking queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import ranking as R
from hornbeam.operators.bundle import metric_bundle
from hornbeam.sources.tables import UNITS_SQL, units

#: SQL expressions, so that importing this needs no session.
RISK, POSITIVE = "10 - score", "defects > 0"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def auc_pooled(spark, d):
    return _rounded(R.auc(units(spark, d), [], RISK, POSITIVE), "auc")


def auc_by_cluster(spark, d):
    return _rounded(R.auc(units(spark, d), ["cluster"], RISK, POSITIVE), "auc")


def auc_null_policy(spark, d):
    """The other policy for one class only: units by cluster and outcome count, where most groups are degenerate."""
    u = units(spark, d).withColumn("slice", F.least("defects", F.lit(1)))
    return _rounded(R.auc(u, ["cluster", "slice"], RISK, POSITIVE, degenerate=None), "auc")


def roc_curve(spark, d):
    return _rounded(R.roc_curve(units(spark, d), [], RISK, POSITIVE), "threshold", "tpr", "fpr")


def popt_by_cluster(spark, d):
    return _rounded(R.popt(units(spark, d), ["cluster"], "score"), "area_model", "area_optimal", "area_worst", "popt")


def popt_pooled(spark, d):
    return _rounded(R.popt(units(spark, d), [], "score"), "area_model", "area_optimal", "area_worst", "popt")


def popt_external(spark, d):
    """The variant that orders by risk alone, ties by input order."""
    return _rounded(R.popt(units(spark, d), ["cluster"], "score", size_tie=False).select("cluster", "popt"), "popt")


def alberg_curve(spark, d):
    return _rounded(R.alberg_curve(units(spark, d), ["cluster"], "score"), "size_share", "defect_share")


def effort20_by_cluster(spark, d):
    return _rounded(R.effort(units(spark, d), ["cluster"], "score"), "precision", "recall_defects", "recall_files")


def effort20_pooled(spark, d):
    return _rounded(R.effort(units(spark, d), [], "score"), "precision", "recall_defects", "recall_files")


def precision_at_k(spark, d):
    return _rounded(R.precision_at_k(units(spark, d), "score", 20), "precision")


def bottom_files(spark, d):
    """The inspected files themselves."""
    return units(spark, d).orderBy("score", "ord").limit(20).select("unit_id", "score", "defects")


def spearman(spark, d):
    return _rounded(R.spearman(units(spark, d), ["cluster"], "score", "defects"), "rho", "p")


def partial_spearman(spark, d):
    return _rounded(R.partial_spearman(units(spark, d), ["cluster"], "score", "defects", "size"), "rho_xy", "rho_xz", "rho_yz", "partial")


def pearson(spark, d):
    return _rounded(R.pearson(units(spark, d), ["cluster"], "score", "defects"), "r")


def midrank(spark, d):
    return R.midranks(units(spark, d).select("unit_id", "cluster", "score"), ["cluster"], "score", "twice_rank")


def cluster_report(spark, d):
    """AUC, Popt and effort metrics of every cluster: the headline."""
    return _rounded(metric_bundle(units(spark, d), ["cluster"]).select("cluster", "n", "n_pos", "auc", "popt", "precision", "recall_defects"), "auc", "popt", "precision", "recall_defects")


def _auc_sql(by: str, degenerate: str = "0.5", source: str = "u", risk: str = "10 - score", positive: str = "defects > 0") -> str:
    cols = by + ", " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""r as (select {cols} ({positive}) as y, rank() over ({part} order by {risk}) * 2 + count(*) over (partition by {cols} {risk}) - 1 as r2 from {source}),
a as (select {cols} count(*) as n, count(*) filter (y) as n_pos, coalesce(sum(r2) filter (y), 0) as s from r {'group by ' + by if by else ''})
select {cols} n, n_pos, round(case when n_pos in (0, n) then {degenerate} else (s - n_pos * (n_pos + 1))::double / (2.0::double * n_pos * (n - n_pos)) end, 6) as auc from a"""


def popt_sql(by: str, order: str = "score, size, ord", final: str | None = None, source: str = "u") -> str:
    cols = by + ", " if by else ""
    part = f"partition by {by}" if by else ""
    final = final or f"select {cols} n, round(m, 6) as area_model, round(o, 6) as area_optimal, round(1 - o, 6) as area_worst, round(popt, 6) as popt from pp"
    return f"""z as (select {cols} ord, score, greatest(size, 1) as size, defects from {source}),
zc as (select {cols} size, defects, sum(defects) over ({part} order by {order} rows unbounded preceding) as cm,
  sum(defects) over ({part} order by defects::double / size desc, ord rows unbounded preceding) as co from z),
za as (select {cols} count(*) as n, sum(defects) as d, sum(size * (2 * cm - defects))::double / nullif(2.0::double * sum(size) * sum(defects), 0) as m,
  sum(size * (2 * co - defects))::double / nullif(2.0::double * sum(size) * sum(defects), 0) as o from zc {'group by ' + by if by else ''}),
pp as (select {cols} n, m, o, case when d = 0 or n < 3 then null when o - (1 - o) = 0 then 0.5 else 1 - (o - m) / (o - (1 - o)) end as popt from za)
{final}"""


def effort_sql(by: str, final: str | None = None) -> str:
    cols = by + ", " if by else ""
    part = f"partition by {by}" if by else ""
    final = final or f"select {cols} files, inspected, round(p, 6) as precision, round(rd, 6) as recall_defects, round(rf, 6) as recall_files from ee"
    return f"""y as (select {cols} greatest(size, 1) as size, defects, sum(greatest(size, 1)) over ({part} order by score, size, ord rows unbounded preceding) as w,
  sum(greatest(size, 1)) over ({part}) as tw, sum(defects) over ({part}) as td, count(*) filter (defects > 0) over ({part}) as tp,
  row_number() over ({part} order by score, size, ord) as rn from u),
ee as (select {cols} count(*) as files, sum(size)::bigint as inspected, count(*) filter (defects > 0)::double / count(*) as p,
  coalesce(sum(defects)::double / nullif(max(td), 0), 0) as rd, coalesce(count(*) filter (defects > 0)::double / nullif(max(tp), 0), 0) as rf
  from y where w <= 0.2 * tw or rn = 1 {'group by ' + by if by else ''})
{final}"""


def _ranks(names: dict[str, str], by: str = "cluster") -> str:
    return ", ".join(f"rank() over (partition by {by} order by {c}) * 2 + count(*) over (partition by {by}, {c}) - 1 as {n}" for c, n in names.items())


def corr_sql(x: str, y: str) -> str:
    return f"case when count(*) < 3 or min({x}) = max({x}) or min({y}) = max({y}) then null else corr({x}, {y}) end"


def correlation_p_sql(source: str, key: str) -> str:
    """CTE ``cp(key, p)``: two-sided p of ``rho`` of ``n`` pairs.  With t = tan(x) sqrt(n - 2) the density of t is that of
    cos(x) ** (n - 3), integrated by Simpson's rule over 2,000 steps from 0 to asin(|rho|)."""
    step = "(asin(abs(rho)) / 2000)"
    weight = "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"sum({weight} * cos(i * {step}) ** (n - 3)) * any_value({step}) / 3"
    front = "2 * exp(lgamma((any_value(n) - 1) / 2.0::double) - lgamma((any_value(n) - 2) / 2.0::double)) / sqrt(pi())"
    return f"cp as (select {key}, 1 - {front} * {area} as p from {source}, range(2001) g(i) where rho is not null group by {key})"


def upper_tail_sql(source: str, key: str, z: str = "z") -> str:
    """CTE ``pt(key, tail)``: P(Z >= z) of a normal Z, by Simpson's rule over 2,000 steps from 0 to z."""
    step = f"({z} / 2000)"
    weight = "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"sum({weight} * exp(-((i * {step}) ** 2) / 2)) * any_value({step}) / 3 / sqrt(2 * pi())"
    return f"pt as (select {key}, 0.5::double - {area} as tail from {source}, range(2001) g(i) where {z} is not null group by {key})"


WITH = "with " + UNITS_SQL + ", "
SQL = {
    "auc_pooled": WITH + _auc_sql(""),
    "auc_by_cluster": WITH + _auc_sql("cluster"),
    "auc_null_policy": WITH + "v as (select *, least(defects, 1) as slice from u), " + _auc_sql("cluster, slice", "null", "v"),
    "roc_curve": WITH
    + """t as (select 10 - score as threshold, count(*) filter (defects > 0) as p, count(*) filter (defects = 0) as q from u group by 1),
    c as (select threshold, sum(p) over (order by threshold desc) as tp, sum(q) over (order by threshold desc) as fp, sum(p) over () as np, sum(q) over () as nq from t)
    select round(threshold, 6) as threshold, round(tp::double / np, 6) as tpr, round(fp::double / nq, 6) as fpr from c union all select null, 0.0, 0.0""",
    "popt_by_cluster": WITH + popt_sql("cluster"),
    "popt_pooled": WITH + popt_sql(""),
    "popt_external": WITH + popt_sql("cluster", "score, ord", "select cluster, round(popt, 6) as popt from pp"),
    "alberg_curve": WITH
    + """z as (select cluster, ord, score, greatest(size, 1) as size, defects from u)
    select cluster, ord, round(sum(size) over w::double / sum(size) over (partition by cluster), 6) as size_share,
      round(sum(defects) over w::double / nullif(sum(defects) over (partition by cluster), 0), 6) as defect_share
    from z window w as (partition by cluster order by score, size, ord rows unbounded preceding)""",
    "effort20_by_cluster": WITH + effort_sql("cluster"),
    "effort20_pooled": WITH + effort_sql(""),
    "precision_at_k": WITH
    + "t as (select * from u order by score, ord limit 20) select count(*) as k, count(*) filter (defects > 0) as hits, round(count(*) filter (defects > 0)::double / count(*), 6) as precision from t",
    "bottom_files": WITH + "t as (select * from u order by score, ord limit 20) select unit_id, score, defects from t",
    "spearman": WITH + f"r as (select cluster, {_ranks({'score': 'x', 'defects': 'y'})} from u), c as (select cluster, count(*) as n, {corr_sql('x', 'y')} as rho from r group by 1), " + correlation_p_sql("c", "cluster") + " select cluster, n, round(rho, 6) as rho, round(p, 6) as p from c left join cp using (cluster)",
    "partial_spearman": WITH
    + f"""r as (select cluster, {_ranks({'score': 'x', 'defects': 'y', 'size': 'z'})} from u),
    c as (select cluster, count(*) as n, {corr_sql('x', 'y')} as a, {corr_sql('x', 'z')} as b, {corr_sql('y', 'z')} as c from r group by 1)
    select cluster, n, round(a, 6) as rho_xy, round(b, 6) as rho_xz, round(c, 6) as rho_yz,
      round(case when sqrt((1 - b * b) * (1 - c * c)) = 0 then 0.0 else (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) end, 6) as partial from c""",
    "pearson": WITH + f"r as (select cluster, count(*) as n, round({corr_sql('score', 'defects')}, 6) as r from u group by 1) select * from r",
    "midrank": WITH + f"r as (select unit_id, cluster, score, {_ranks({'score': 'twice_rank'})} from u) select * from r",
}
SQL["cluster_report"] = (
    WITH
    + _auc_sql("cluster").rsplit("\nselect", 1)[0]
    + ", x1 as (select"
    + _auc_sql("cluster").rsplit("\nselect", 1)[1]
    + "), "
    + popt_sql("cluster", final=", x2 as (select cluster, round(popt, 6) as popt from pp), ")
    + effort_sql("cluster", final=", x3 as (select cluster, round(p, 6) as precision, round(rd, 6) as recall_defects from ee) select * from x1 left join x2 using (cluster) left join x3 using (cluster)")
)

QUERIES = {
    f.__name__: f
    for f in (
        auc_pooled, auc_by_cluster, auc_null_policy, roc_curve, popt_by_cluster, popt_pooled, popt_external, alberg_curve,
        effort20_by_cluster, effort20_pooled, precision_at_k, bottom_files, spearman, partial_spearman, pearson, midrank, cluster_report,
    )
}
