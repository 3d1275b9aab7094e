"""Registered queries on predictors, DeLong tests and bootstrap intervals, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import inference as I
from hornbeam.operators import ranking as R
from hornbeam.operators import resampling as B
from hornbeam.plans.rank_queries import POSITIVE, RISK, WITH, _auc_sql, _ranks, _rounded, corr_sql, popt_sql, upper_tail_sql
from hornbeam.sources.store import written
from hornbeam.sources.tables import read, units

#: Resamples of every registered bootstrap, the reference's number; the equivalents in SQL draw as many.
REPS, SEED = 2000, "12345"
#: And of the differences within clusters.
WITHIN_REPS = 600


def predictors(spark, d):
    """Units in long form, one row for each predictor: score, size, churn, earlier defects, random."""
    line = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.count("*").alias("churn"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.085)).alias("prior")
    )
    u = units(spark, d)
    u = u.join(line, u["unit_id"] == line["k"], "left").fillna(0, ["churn", "prior"]).drop("k")
    random = F.conv(F.substring(F.md5(F.col("unit_id").cast("string")), 1, 8), 16, 10).cast("double")
    risks = {"score": F.expr(RISK), "size": F.col("size").cast("double"), "churn": F.col("churn").cast("double"), "prior": F.col("prior").cast("double"), "random": random}
    pairs = F.array(*(F.struct(F.lit(k).alias("predictor"), v.alias("risk")) for k, v in risks.items()))
    return u.select("unit_id", "cluster", "ord", "size", "defects", F.explode(pairs).alias("p")).select("unit_id", "cluster", "ord", "size", "defects", "p.predictor", "p.risk")


def baselines_auc(spark, d):
    return _rounded(R.auc(predictors(spark, d), ["predictor"], "risk", POSITIVE), "auc")


def baselines_popt(spark, d):
    p = predictors(spark, d).withColumn("score", -F.col("risk"))
    return _rounded(R.popt(p, ["predictor"], "score").select("predictor", "popt"), "popt")


def best_baseline(spark, d):
    """The baseline whose mean AUC over clusters is greatest, the first by name among equals."""
    per = R.auc(predictors(spark, d).where("predictor <> 'score'"), ["predictor", "cluster"], "risk", POSITIVE, degenerate=None)
    mean = per.groupBy("predictor").agg(F.avg("auc").alias("mean_auc"))
    return _rounded(mean.orderBy(F.round("mean_auc", 9).desc_nulls_last(), "predictor").limit(1), "mean_auc")


def _two(spark, d):
    return units(spark, d).withColumn("a", F.expr(RISK)).withColumn("b", 10 - F.col("rival"))


def delong_components(spark, d):
    out = I.delong(_two(spark, d), ["cluster"], "a", "b", POSITIVE)
    return _rounded(out.withColumns({c: F.col(c) * 1000 for c in ("var_a", "cov", "var_b")}), "auc_a", "auc_b", "var_a", "cov", "var_b", "delta", "z")


def delong_z(spark, d):
    out = I.delong(_two(spark, d), [], "a", "b", POSITIVE)
    return _rounded(out.select("auc_a", "auc_b", "delta", "z", I.two_sided(F.col("z")).alias("p")), "auc_a", "auc_b", "delta", "z", "p")


def head_to_head(spark, d):
    """Every headline metric for two scorers of the same units: the scorer is a grouping column."""
    u = units(spark, d)
    both = u.withColumn("tool", F.lit("a")).unionByName(u.withColumn("score", F.col("rival")).withColumn("tool", F.lit("b")))
    a, p = R.auc(both, ["tool"], RISK, POSITIVE), R.popt(both, ["tool"], "score").select("tool", "popt")
    e = R.effort(both, ["tool"], "score").select("tool", "precision", "recall_defects", "recall_files")
    s = R.partial_spearman(both, ["tool"], "score", "defects", "size").select("tool", F.col("partial").alias("partial_rho"))
    return _rounded(a.join(p, "tool").join(e, "tool").join(s, "tool"), "auc", "popt", "precision", "recall_defects", "recall_files", "partial_rho")


def _auc_cells(spark, d):
    """Units with risk and outcome ``y``, each of which draws for itself."""
    u = units(spark, d).select("cluster", F.expr(RISK).alias("risk"), F.expr(POSITIVE).cast("int").alias("y"), "ord")
    return B.single(u, "ord", SEED)


def boot_ci_auc(spark, d):
    """Interval of each cluster's AUC by drawing its units."""
    arrays = B.areas(_auc_cells(spark, d), "cluster", [F.col("risk")], F.col("y"), 1 - F.col("y"), reps=REPS)
    per = B.by_draw(arrays, "auc").where("x + y > 0").select(F.col("g").alias("cluster"), F.coalesce("auc", F.lit(0.5)).alias("auc"))
    return _rounded(I.interval(per, ["cluster"], "auc"), "lo", "hi")


def within_boot_delta(spark, d):
    """Differences of two risks' mean AUC and Popt over clusters when units are drawn within each cluster: the mean, and the
    values at positions ``int(q * n)`` of the sorted resamples."""
    t = _two(spark, d).select("cluster", "a", "b", F.greatest("size", F.lit(1)).alias("size"), "defects", "ord")
    c = written(B.cells(t, ["cluster", "a", "b", "size", "defects"], "ord", SEED), "cells")
    hit, of = F.expr(POSITIVE).cast("int"), lambda order, x, y, name: B.by_draw(B.areas(c, "cluster", order, x, y, reps=WITHIN_REPS), name)
    area = lambda order, name: of([*order, F.col("ord")], F.col("size"), F.col("defects"), name).select("g", "at", name)
    per = of([F.col("a")], hit, 1 - hit, "auc_a").select("g", "at", (F.col("x") + F.col("y")).alias("n"), "auc_a")
    per = per.join(of([F.col("b")], hit, 1 - hit, "auc_b").select("g", "at", "auc_b"), ["g", "at"]).join(area([-F.col("defects") / F.col("size")], "best"), ["g", "at"])
    for side in "ab":
        per = per.join(area([-F.col(side), F.col("size")], f"area_{side}"), ["g", "at"])
        gap = 2 * F.col("best") - 1
        per = per.withColumn(f"popt_{side}", F.when(F.col("n") >= 3, F.when(gap == 0, 0.5).otherwise(1 - (F.col("best") - F.col(f"area_{side}")) / gap)))
    per = per.groupBy("at").agg(*(F.avg(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(m) for m in ("auc", "popt")))
    long = per.select(F.inline(F.array(*(F.struct(F.lit(m).alias("of"), F.col(m).alias("delta")) for m in ("auc", "popt")))))
    values = F.array_sort(F.collect_list("delta"))  # WITHIN_REPS numbers
    at = lambda q: F.element_at("v", F.floor(q * F.size("v")).cast("int") + 1)
    out = long.groupBy("of").agg(values.alias("v"), F.avg("delta").alias("mean")).select("of", "mean", at(0.025).alias("lo"), at(0.975).alias("hi"))
    return _rounded(out, "mean", "lo", "hi")


def _two_stage(spark, d):
    """(cells, ``cluster, js``, number of clusters): clusters are drawn, then units within each slot anew.  Draw ``rep * k + slot``
    of a cluster is what a slot that took it has; a cluster has about as many as there are resamples."""
    c = written(_auc_cells(spark, d), "cells")
    names = written(I.indexed(c.groupBy("cluster").agg(F.min("ord").alias("first")), [], "first", "cluster_at"), "clusters")
    k = names.count()
    draws = I.cluster_draws(names, k, REPS, SEED).join(names, "cluster_at").groupBy("cluster").agg(F.sort_array(F.collect_list(F.col("rep") * k + F.col("slot"))).alias("js"))
    return c, written(draws, "draws"), k


def cluster_boot_mean_auc(spark, d):
    """Two-stage interval of the mean over drawn clusters."""
    c, draws, k = _two_stage(spark, d)
    arrays = B.areas(c, "cluster", [F.col("risk")], F.col("y"), 1 - F.col("y"), draws=draws)
    slots = draws.select(F.col("cluster").alias("g"), F.posexplode("js").alias("at", "j"))
    per = B.by_draw(arrays, "auc").join(slots, ["g", "at"]).withColumn("rep", F.expr(f"j div {k}"))
    mean = per.groupBy("rep").agg(F.avg("auc").alias("auc")).withColumn("of", F.lit("mean"))
    return _rounded(I.interval(mean, ["of"], "auc"), "lo", "hi")


def pooled_boot(spark, d):
    """Two-stage interval of the metric over all drawn rows."""
    c, draws, k = _two_stage(spark, d)
    arrays = B.areas(c, None, [F.col("risk")], F.col("y"), 1 - F.col("y"), draws=draws, per=k)
    per = B.by_draw(arrays, "auc").select(F.coalesce("auc", F.lit(0.5)).alias("auc"), F.lit("pooled").alias("of"))
    return _rounded(I.interval(per, ["of"], "auc"), "lo", "hi")


def _cluster_weights(spark, table):
    """``cluster, rep, weight``: how often each resample draws each cluster."""
    names = I.indexed(table.groupBy("cluster").agg(F.min("ord").alias("first")), [], "first", "cluster_at")
    k = names.count()
    return I.cluster_draws(names, k, REPS, SEED).groupBy("rep", "cluster_at").agg(F.count("*").alias("weight")).join(names, "cluster_at").select("cluster", "rep", "weight")


def cluster_ci_ratio(spark, d):
    """One-stage interval of the pooled alert to healthy ratio: clusters' sums, weighted by how often they are drawn."""
    u = units(spark, d)
    part = lambda c, x: F.sum(F.when(F.expr(c), x).otherwise(0))
    sums = u.groupBy("cluster").agg(
        part("score < 4", F.col("defects")).alias("da"), part("score < 4", F.lit(1)).alias("na"), part("score >= 8", F.col("defects")).alias("dh"), part("score >= 8", F.lit(1)).alias("nh")
    )
    j = sums.join(_cluster_weights(spark, u), "cluster")
    tot = lambda c: F.sum(F.col(c) * F.col("weight"))
    per = j.groupBy("rep").agg(F.try_divide(F.try_divide(tot("da"), tot("na")), F.try_divide(tot("dh"), tot("nh"))).alias("ratio")).withColumn("of", F.lit("ratio"))
    return _rounded(I.interval(per, ["of"], "ratio"), "lo", "hi")


def paired_delta(spark, d):
    """Intervals of the mean differences of two scorers' AUC and Popt over drawn clusters; each cluster's differences are
    made once."""
    t = written(_two(spark, d), "units")
    auc = [R.auc(t, ["cluster"], x, POSITIVE, None).select("cluster", F.col("auc").alias("v")) for x in "ab"]
    popt = [R.popt(t.withColumn("score", -F.col(x)), ["cluster"], "score").select("cluster", F.col("popt").alias("v")) for x in "ab"]
    deltas = None
    for of, (a, b) in (("auc", auc), ("popt", popt)):
        one = a.join(b.withColumnRenamed("v", "w"), "cluster").select("cluster", F.lit(of).alias("of"), (F.col("v") - F.col("w")).alias("delta"))
        deltas = one if deltas is None else deltas.unionByName(one)
    j = deltas.where("delta is not null").join(_cluster_weights(spark, t), "cluster")
    per = j.groupBy("of", "rep").agg((F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("delta"))
    out = per.groupBy("of").agg(
        F.percentile("delta", 0.025).alias("lo"), F.percentile("delta", 0.975).alias("hi"), F.avg((F.round("delta", 9) <= 0).cast("int")).alias("p_le0")
    )
    return _rounded(out, "lo", "hi", "p_le0")


def paired_pooled_delta(spark, d):
    """Interval and two-sided p of the difference of two scorers' pooled AUC, the same drawn clusters for both."""
    t = written(_two(spark, d).select("cluster", "ord", "a", "b", "defects"), "units")
    weights = written(_cluster_weights(spark, t), "weights")
    counts = t.groupBy("cluster").agg(F.count_if(F.expr(POSITIVE)).alias("p"), F.count_if(~F.expr(POSITIVE)).alias("q"))
    a, b = (I.pooled_auc(I.concordance(t, "cluster", x, POSITIVE), counts, weights) for x in "ab")
    per = a.join(b.withColumnRenamed("auc", "other"), "rep").select(F.lit("auc").alias("of"), F.round(F.col("auc") - F.col("other"), 9).alias("delta"))
    out = per.groupBy("of").agg(
        F.percentile("delta", 0.025).alias("lo"), F.percentile("delta", 0.975).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("delta") <= 0).cast("int")), F.avg((F.col("delta") >= 0).cast("int")))).alias("p"),
    )
    return _rounded(out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)), "lo", "hi", "p")


_IDX = lambda n, *parts: "(('0x' || substr(md5(" + " || '|' || ".join(parts) + f"), 1, 8))::bigint % {n})"
_PRED = """pl as (select l_partkey as k, count(*) as churn, count(*) filter (l_returnflag = 'R' and l_discount < 0.085) as prior from lineitem group by 1),
p0 as (select u.*, coalesce(churn, 0) as churn, coalesce(prior, 0) as prior from u left join pl on k = unit_id),
p as (select unit_id, cluster, ord, size, defects, 'score' as predictor, 10 - score as risk from p0 union all select unit_id, cluster, ord, size, defects, 'size', size::double from p0
  union all select unit_id, cluster, ord, size, defects, 'churn', churn::double from p0 union all select unit_id, cluster, ord, size, defects, 'prior', prior::double from p0
  union all select unit_id, cluster, ord, size, defects, 'random', ('0x' || substr(md5(unit_id::varchar), 1, 8))::bigint::double from p0)"""


def _delong_sql(by: str) -> str:
    cols, part = (by + ", ", f"partition by {by}") if by else ("", "")
    mid = lambda c, p: f"rank() over ({p} order by {c}) + (count(*) over ({'partition by ' if not p else p + ', '}{c}) - 1) / 2.0::double"
    own = f"partition by {cols}y"
    return f"""t as (select {cols} 10 - score as a, 10 - rival as b, defects > 0 as y from u),
r as (select {cols} y, {mid('a', part)} as za, {mid('b', part)} as zb, {mid('a', own)} as oa, {mid('b', own)} as ob,
  count(*) filter (y) over ({part}) as m, count(*) filter (not y) over ({part}) as n from t),
v as (select {cols} y, m, n, case when y then (za - oa) / nullif(n, 0) else 1 - (za - oa) / nullif(m, 0) end as va, case when y then (zb - ob) / nullif(n, 0) else 1 - (zb - ob) / nullif(m, 0) end as vb from r),
s as (select {cols} max(m) as n_pos, max(n) as n_neg, avg(va) filter (y) as auc_a, avg(vb) filter (y) as auc_b,
  coalesce(covar_samp(va, va) filter (y), 0) / nullif(max(m), 0) + coalesce(covar_samp(va, va) filter (not y), 0) / nullif(max(n), 0) as var_a,
  coalesce(covar_samp(va, vb) filter (y), 0) / nullif(max(m), 0) + coalesce(covar_samp(va, vb) filter (not y), 0) / nullif(max(n), 0) as cov,
  coalesce(covar_samp(vb, vb) filter (y), 0) / nullif(max(m), 0) + coalesce(covar_samp(vb, vb) filter (not y), 0) / nullif(max(n), 0) as var_b from v {'group by ' + by if by else ''}),
x as (select *, auc_a - auc_b as delta, case when var_a + var_b - 2 * cov > 1e-15 then (auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov) end as z from s)"""


def _weighted_auc(by: str, source: str, risk: str = "10 - score", degenerate: str = "0.5") -> str:
    return f"""g as (select {by}, {risk} as r, sum(weight) filter (defects > 0) as p, sum(weight) filter (defects = 0) as q from {source} group by {by}, {risk}),
c as (select {by}, coalesce(p, 0) as p, coalesce(q, 0) as q, sum(coalesce(q, 0)) over (partition by {by} order by r) as neg from g),
per as (select {by}, case when sum(p) = 0 or sum(q) = 0 then {degenerate} else sum(p * (2 * neg - q))::double / (2.0::double * sum(p) * sum(q)) end as auc from c group by {by})"""


_NAMES = "nm as (select cluster, count(*) as n, row_number() over (order by min(ord)) - 1 as cluster_at from u group by 1), kk as (select count(*) as k from nm)"
def _drawn_sql(cells: str, seed: str = SEED) -> str:
    """CTE ``cx``: the cells with their stream and, as ``t``, where the Poisson distribution with mean n passes 0, 1, 2, ..."""
    return f"""tk as (select n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) over (partition by n order by k) as cdf from (select distinct n::double as n from {cells}), range(20000) r(k) where k <= n + 12 * sqrt(n) + 30),
th as (select n::bigint as n, list(round({I.PRIME} * cdf)::bigint order by k) as t from tk group by 1),
cx as (select *, ('0x' || substr(md5('{seed}|' || ord), 1, 8))::bigint % {I.PRIME} as ha, ('0x' || substr(md5('{seed}|' || ord), 9, 8))::bigint % {I.PRIME} as hb from {cells} join th using (n))"""


_DRAWN = lambda j: f"len(list_filter(t, lambda v: v <= (ha + ({j}) * hb) % {I.PRIME}))"
_DRAWS = f"""ub as (select *, ('0x' || substr(md5('{SEED}|' || ord), 1, 8))::bigint % {I.PRIME} as ha, ('0x' || substr(md5('{SEED}|' || ord), 9, 8))::bigint % {I.PRIME} as hb from u)"""
_TAKEN = lambda j: "(" + " + ".join(f"(((ha + ({j}) * hb) % {I.PRIME}) >= {x})::int" for x in B.LIMITS) + ")"
_WITHIN = _DRAWS + f", ds as (select * from (select *, {_TAKEN('rep')} as weight from ub, range({REPS}) a(rep)) where weight > 0), "
_SLOTS = _NAMES + f""", sl as (select rep, slot, {_IDX('k', f"'{SEED}|c'", 'rep', 'slot')} as cluster_at from range({REPS}) a(rep), kk, (select unnest(range(k)) as slot from kk)),
sl2 as (select cluster, rep, slot, (select k from kk) as k from sl join nm using (cluster_at)),
ds as (select * from (select rep, slot, score, defects, {_TAKEN('rep * k + slot')} as weight from ub join sl2 using (cluster)) where weight > 0)"""


def _weighted_popt(side: str) -> str:
    """CTE ``p_side(cluster, rep, popt)`` of ``dw``, whose rows count ``weight`` times."""
    before = lambda order: f"sum(weight * defects) over (partition by cluster, rep order by {order} rows between unbounded preceding and current row)"
    return f"""c_{side} as (select cluster, rep, size, defects, weight, {before(f'-{side}, size, ord')} as cm, {before('-(defects::double / size), ord')} as co from dw),
a_{side} as (select cluster, rep, sum(weight) as n, sum(weight * defects) as d, sum(weight * size * (2 * cm - weight * defects))::double / nullif(2.0::double * sum(weight * size) * sum(weight * defects), 0) as m,
  sum(weight * size * (2 * co - weight * defects))::double / nullif(2.0::double * sum(weight * size) * sum(weight * defects), 0) as o from c_{side} group by 1, 2),
p_{side} as (select cluster, rep, case when d = 0 or n < 3 then null when 2 * o - 1 = 0 then 0.5 else 1 - (o - m) / (2 * o - 1) end as popt from a_{side})"""


_WEIGHTS = _NAMES + f""", cw as (select cluster, rep, count(*) as weight from (select rep, {_IDX('k', f"'{SEED}|c'", 'rep', 'slot')} as cluster_at from range({REPS}) a(rep), kk, (select unnest(range(k)) as slot from kk)) join nm using (cluster_at) group by 1, 2)"""
_CI = lambda v: f"round(quantile_cont({v}, 0.025), 6) as lo, round(quantile_cont({v}, 0.975), 6) as hi"

SQL = {
    "baselines_auc": WITH + _PRED + ", " + _auc_sql("predictor", source="p", risk="risk"),
    "baselines_popt": WITH + _PRED + ", pq as (select predictor, ord, -risk as score, size, defects from p), " + popt_sql("predictor", final="select predictor, round(popt, 6) as popt from pp", source="pq"),
    "best_baseline": WITH + _PRED + ", pb as (select * from p where predictor <> 'score'), " + _auc_sql("predictor, cluster", "null", "pb", "risk").rsplit("\nselect", 1)[0]
    + """, y as (select predictor, avg(case when n_pos in (0, n) then null else (s - n_pos * (n_pos + 1))::double / (2.0::double * n_pos * (n - n_pos)) end) as m from a group by 1)
select predictor, round(m, 6) as mean_auc from y order by round(m, 9) desc nulls last, predictor limit 1""",
    "delong_components": WITH + _delong_sql("cluster") + " select cluster, n_pos, n_neg, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(var_a * 1000, 6) as var_a, round(cov * 1000, 6) as cov, round(var_b * 1000, 6) as var_b, round(delta, 6) as delta, round(z, 6) as z from x",
    "delong_z": WITH + _delong_sql("") + ", zz as (select 1 as one, *, abs(z) as az from x), " + upper_tail_sql("zz", "one", "az")
    + " select round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(delta, 6) as delta, round(z, 6) as z, round(2 * tail, 6) as p from zz left join pt using (one)",
    "head_to_head": WITH + "bt as (select *, 'a' as tool from u union all select * replace (rival as score), 'b' from u), " + _auc_sql("tool", source="bt").rsplit("\nselect", 1)[0] + ", x1 as (select" + _auc_sql("tool", source="bt").rsplit("\nselect", 1)[1] + "), "
    + popt_sql("tool", source="bt", final=", x2 as (select tool, round(popt, 6) as popt from pp), ")
    + """y as (select tool, greatest(size, 1) as size, defects, sum(greatest(size, 1)) over w as cw, sum(greatest(size, 1)) over (partition by tool) as tw, sum(defects) over (partition by tool) as td,
  count(*) filter (defects > 0) over (partition by tool) as tp, row_number() over w as rn from bt window w as (partition by tool order by score, size, ord rows unbounded preceding)),
x3 as (select tool, round(count(*) filter (defects > 0)::double / count(*), 6) as precision, round(sum(defects)::double / max(td), 6) as recall_defects,
  round(count(*) filter (defects > 0)::double / max(tp), 6) as recall_files from y where cw <= 0.2 * tw or rn = 1 group by 1), """
    + f"""rk as (select tool, {_ranks({'score': 'x', 'defects': 'y', 'size': 'z'}, 'tool')} from bt),
ck as (select tool, {corr_sql('x', 'y')} as a, {corr_sql('x', 'z')} as b, {corr_sql('y', 'z')} as c from rk group by 1),
x4 as (select tool, round(case when sqrt((1 - b * b) * (1 - c * c)) = 0 then 0.0 else (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) end, 6) as partial_rho from ck)
select * from x1 join x2 using (tool) join x3 using (tool) join x4 using (tool)""",
    "boot_ci_auc": WITH + _WITHIN + _weighted_auc("cluster, rep", "ds") + f" select cluster, {_CI('auc')}, count(auc) as n_boot from per group by 1",
    "within_boot_delta": WITH + "cw as (select cluster, 10 - score as a, 10 - rival as b, greatest(size, 1) as size, defects, count(*) as n, min(ord) as ord from u group by 1, 2, 3, 4, 5), " + _drawn_sql("cw")
    + f", dw as (select cluster, rep, a, b, size, defects, ord, {_DRAWN('rep')} as weight from cx, range({WITHIN_REPS}) r(rep)), "
    + _weighted_auc("cluster, rep", "dw", "a", "null").replace("g as (", "g1 as (").replace("from g)", "from g1)").replace("c as (", "c1 as (").replace("from c group", "from c1 group").replace("per as (", "pa as (")
    + ", " + _weighted_auc("cluster, rep", "dw", "b", "null").replace("per as (", "pb as (") + ", " + _weighted_popt("a") + ", " + _weighted_popt("b")
    + """, m as (select 'auc' as of, rep, avg(pa.auc - pb.auc) as d from pa join pb using (cluster, rep) group by 2 union all select 'popt', rep, avg(p_a.popt - p_b.popt) from p_a join p_b using (cluster, rep) group by 2),
l as (select of, list(d order by d) filter (d is not null) as v, avg(d) as mean from m group by 1)
select of, round(mean, 6) as mean, round(v[floor(0.025 * len(v))::int + 1], 6) as lo, round(v[floor(0.975 * len(v))::int + 1], 6) as hi from l""",
    "cluster_boot_mean_auc": WITH + _DRAWS + ", " + _SLOTS + ", " + _weighted_auc("rep, slot", "ds", degenerate="null") + f", mm as (select rep, avg(auc) as auc from per group by 1) select 'mean' as of, {_CI('auc')}, count(auc) as n_boot from mm",
    "pooled_boot": WITH + _DRAWS + ", " + _SLOTS + ", " + _weighted_auc("rep", "ds") + f" select 'pooled' as of, {_CI('auc')}, count(auc) as n_boot from per",
    "cluster_ci_ratio": WITH + _WEIGHTS + """, s as (select cluster, sum(defects) filter (score < 4) as da, count(*) filter (score < 4) as na, sum(defects) filter (score >= 8) as dh, count(*) filter (score >= 8) as nh from u group by 1),
per as (select rep, (sum(coalesce(da, 0) * weight) / nullif(sum(na * weight), 0)::double) / nullif(sum(coalesce(dh, 0) * weight) / nullif(sum(nh * weight), 0)::double, 0) as ratio from s join cw using (cluster) group by 1)
select 'ratio' as of, """ + _CI("ratio") + ", count(ratio) as n_boot from per",
    "paired_delta": WITH + _WEIGHTS + ", " + _delong_sql("cluster") + ", t1 as (select cluster, ord, size, defects, score - 10 as score from u), t2 as (select cluster, ord, size, defects, rival - 10 as score from u), "
    + popt_sql("cluster", source="t1", final=", ").replace("z as (", "z1 as (").replace("from z)", "from z1)").replace("zc as (", "zc1 as (").replace("from zc ", "from zc1 ").replace("za as (", "za1 as (").replace("from za)", "from za1)").replace("pp as (", "p1 as (")
    + popt_sql("cluster", source="t2", final=", ")
    + f"""dl as (select 'auc' as of, cluster, delta from x union all select 'popt', cluster, p1.popt - pp.popt from p1 join pp using (cluster)),
per as (select of, rep, sum(delta * weight) / sum(weight) as delta from dl join cw using (cluster) where delta is not null group by 1, 2)
select of, {_CI('delta')}, round(avg((round(delta, 9) <= 0)::int), 6) as p_le0 from per group by 1""",
    "paired_pooled_delta": WITH + _WEIGHTS + ", ds as (select u.*, rep, weight from u join cw using (cluster)), " + _weighted_auc("rep", "ds", "10 - score").replace("g as", "g1 as").replace("from g)", "from g1)").replace("c as (select rep, coalesce", "c1 as (select rep, coalesce").replace("from g1)", "from g1)").replace("per as", "pa as").replace("from c group", "from c1 group").replace("from g),", "from g1),")
    + ", " + _weighted_auc("rep", "ds", "10 - rival").replace("per as", "pb as")
    + f""", pd as (select round(pa.auc - pb.auc, 9) as delta from pa join pb using (rep)), q as (select quantile_cont(delta, 0.025) as lo, quantile_cont(delta, 0.975) as hi, least(1.0, 2 * least(avg((delta <= 0)::int), avg((delta >= 0)::int))) as p from pd)
select 'auc' as of, round(lo, 6) as lo, round(hi, 6) as hi, round(p, 6) as p, lo > 0 or hi < 0 as excludes_zero from q""",
}

QUERIES = {
    f.__name__: f
    for f in (
        baselines_auc, baselines_popt, best_baseline, delong_components, delong_z, head_to_head, boot_ci_auc, within_boot_delta, cluster_boot_mean_auc, pooled_boot, cluster_ci_ratio, paired_delta, paired_pooled_delta,
    )
}
