"""Registered queries on densities, bands, findings and effect sizes, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import groups as G
from hornbeam.operators import ranking as R
from hornbeam.plans.rank_queries import POSITIVE, RISK, WITH, _auc_sql, _rounded, popt_sql, upper_tail_sql
from hornbeam.sources.tables import FINDINGS_SQL, findings, units

ROSTER = ["AF", "AO", "NF", "NO", "RF", "RO", "XX"]
SETTINGS = [(w, cap) for w in (1.0, 2.0, 3.0, 4.0) for cap in (1.0, 2.0, 3.0)]
FLOORS = [0, 400, 600, 800]


def density_ratio(spark, d):
    return _rounded(G.density_ratio(units(spark, d), ["cluster"], 4, 8), "low_mean", "high_mean", "low_per_k", "high_per_k", "ratio", "per_k_ratio")


def density_by_bucket(spark, d):
    return _rounded(G.density_by_bucket(units(spark, d)), "mean_defects", "per_k")


def category_stats(spark, d):
    return _rounded(G.category_stats(units(spark, d), ["cluster"]), "mean_defects", "per_k")


def category_ratio(spark, d):
    """Alert to healthy ratios of each cluster; null where the healthy side is 0 or absent."""
    s = G.category_stats(units(spark, d), ["cluster"])
    pick = lambda c, k: F.max(F.when(F.col("category") == k, F.col(c)))
    ratio = lambda c: F.when(pick(c, "healthy") > 0, F.try_divide(pick(c, "alert"), pick(c, "healthy")))
    return _rounded(s.groupBy("cluster").agg(ratio("mean_defects").alias("per_file"), ratio("per_k").alias("per_k")), "per_file", "per_k")


def colour_groups(spark, d):
    """Sizes and means of red, yellow and green; an empty colour is a row of zeros."""
    colour = F.when(F.col("score") >= 8, "green").when(F.col("score") >= 4, "yellow").otherwise("red")
    s = units(spark, d).where("size < 500").groupBy(colour.alias("colour")).agg(F.count("*").alias("n"), F.avg("defects").alias("mean"))
    names = spark.createDataFrame([("red",), ("yellow",), ("green",)], "colour string")
    return _rounded(names.join(s, "colour", "left").fillna(0, ["n", "mean"]), "mean")


def descriptive(spark, d):
    return _rounded(G.descriptive(units(spark, d), ["cluster"], "defects"), "pct_zero", "mean", "median", "std")


def kruskal_h(spark, d):
    group = F.when(F.col("score") >= 8, "green").when(F.col("score") >= 4, "yellow").otherwise("red")
    return _rounded(G.kruskal(units(spark, d), ["cluster"], group, "defects"), "h", "p")


def kruskal_many(spark, d):
    """More groups than three: seven in each cluster."""
    return _rounded(G.kruskal(units(spark, d), ["cluster"], F.pmod("unit_id", F.lit(7)), "defects"), "h", "p")


def mannwhitney_small(spark, d):
    """Few units against the others of their cluster and stratum, by a score that has ties in some: exact where it can be."""
    return _rounded(G.mann_whitney(units(spark, d), ["cluster", "stratum"], "unit_id % 4 = 0", "rival", least=2), "u", "p")


def cliffs_delta_by_biomarker(spark, d):
    return _rounded(G.with_without(units(spark, d), findings(spark, d), ROSTER, "defects"), "mean_with", "mean_without", "delta", "z")


def mannwhitney_p(spark, d):
    table = G.with_without(units(spark, d), findings(spark, d), ROSTER, "defects")
    return _rounded(table.select("biomarker", "u", G.normal_tail(F.col("z")).alias("p")), "p")


def biomarker_ranking(spark, d):
    """Position by delta, greatest first, roster order among equals."""
    from pyspark.sql import Window

    table = G.with_without(units(spark, d), findings(spark, d), ROSTER, "defects").withColumn("delta", F.round("delta", 6))
    place = F.array_position(F.array(*map(F.lit, ROSTER)), F.col("biomarker"))
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("delta").desc(), place))  # a row a biomarker
    return table.select(at.alias("rank"), "biomarker", "delta")


def dominant_biomarker(spark, d):
    u = units(spark, d).select("unit_id")
    joined = u.join(G.dominant(findings(spark, d)), "unit_id", "left").fillna(0, ["weighted", "impact", "findings"]).fillna("<none>", ["dominant"])
    return _rounded(joined, "impact")


def findings_per_file(spark, d):
    counts = findings(spark, d).groupBy("unit_id").agg(F.count("*").alias("finding_count"))
    return units(spark, d).select("unit_id", "cluster").join(counts, "unit_id", "left").fillna(0, ["finding_count"])


def max_magnitude(spark, d):
    """Greatest positive magnitude of each unit and biomarker."""
    return findings(spark, d).where("magnitude > 0").groupBy("unit_id", "biomarker").agg(F.max("magnitude").alias("magnitude"))


def fingerprint(spark, d):
    """The five most common biomarkers of each cluster's defective units as ``countxname``."""
    bad = units(spark, d).where("defects > 0").select("unit_id", "cluster")
    counts = findings(spark, d).join(bad, "unit_id").groupBy("cluster", "biomarker").agg(F.count("*").alias("c"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), F.col("biomarker").alias("b")))), 1, 5)
    text = F.array_join(F.transform(top, lambda x: F.concat((-x["k"]).cast("string"), F.lit("x"), x["b"])), ", ")
    return counts.groupBy("cluster").agg(text.alias("fingerprint"))


def nloc_quartiles(spark, d):
    u = units(spark, d)
    return _rounded(u.agg(*(F.percentile("size", q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75), 1))), "q1", "q2", "q3")


def auc_by_band(spark, d):
    return _rounded(R.auc(G.bands(units(spark, d)), ["band"], RISK, POSITIVE), "auc")


def band_zscore(spark, d):
    z = G.standardised(G.bands(units(spark, d)), ["cluster", "band"], "score", "z")
    return _rounded(z.select("unit_id", "cluster", "band", "z"), "z")


def band_rank(spark, d):
    """Ordinal rank / (n - 1) within cluster and band, ties by input order."""
    b = G.bands(units(spark, d)).withColumn("one", F.lit(1))
    run = R.running(b, ["cluster", "band"], [F.col("score"), F.col("ord")], {"at": "one"})
    n = b.groupBy(F.col("cluster").alias("c"), F.col("band").alias("d")).agg(F.count("*").alias("n"))
    both = run.join(n, R.safe(["cluster", "band"], ["c", "d"]))
    return _rounded(both.select("unit_id", ((F.col("at") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("rank")), "rank")


def size_residual(spark, d):
    r = G.residual(units(spark, d), ["cluster"], RISK, F.log1p("size"), "residual")
    return _rounded(r.select("unit_id", "cluster", "residual"), "residual")


def residual_auc(spark, d):
    r = G.residual(units(spark, d), [], RISK, F.log1p("size"), "residual").withColumn("residual", F.round("residual", 9))
    return _rounded(R.auc(r, ["cluster"], F.col("residual"), POSITIVE), "auc")


def leave_cluster_out(spark, d):
    out = G.leave_out_auc(units(spark, d), "cluster", RISK, POSITIVE)
    return _rounded(out, "auc_within", "auc_without")


def cluster_cost(spark, d):
    u = units(spark, d)
    lo = G.leave_out_auc(u, "cluster", RISK, POSITIVE)
    whole = R.auc(u, [], RISK, POSITIVE).select(F.col("auc").alias("all"))
    more = u.groupBy("cluster").agg(F.avg("size").alias("mean_size"), F.avg(F.expr(RISK)).alias("mean_risk"), F.avg(F.expr(POSITIVE).cast("int")).alias("rate"))
    out = lo.crossJoin(F.broadcast(whole)).join(more, "cluster").withColumn("delta", F.col("auc_without") - F.col("all"))
    return _rounded(out.select("cluster", "n", "positives", "rate", "auc_within", "delta", "mean_size", "mean_risk"), "rate", "auc_within", "delta", "mean_size", "mean_risk")


def worst_false_positives(spark, d):
    return units(spark, d).where("defects = 0").orderBy("score", "ord").limit(25).select("unit_id", "score", "size")


def worst_false_negatives(spark, d):
    return units(spark, d).where("defects > 0").orderBy(F.desc("score"), F.desc("defects"), "ord").limit(25).select("unit_id", "score", "defects")


def coverage_penalty_grid(spark, d):
    """AUC of a risk with a capped penalty for low coverage, over 12 settings, and which setting is best."""
    u = units(spark, d).withColumn("coverage", F.pmod(F.col("unit_id") * 37, F.lit(101)))
    grid = spark.createDataFrame([(i, w, c) for i, (w, c) in enumerate(SETTINGS)], "setting int, w double, cap double")
    both = u.crossJoin(F.broadcast(grid))
    risk = F.least(F.lit(10.0), 10 - F.col("score") + F.least(F.col("cap"), F.col("w") * F.greatest(F.lit(0.0), (100 - F.col("coverage")) / 100.0)))
    out = R.auc(both, ["setting", "w", "cap"], F.round(risk, 6), POSITIVE)
    best = out.agg(F.max_by("setting", F.struct(F.round("auc", 9), -F.col("setting"))).alias("best"))
    return _rounded(out.crossJoin(F.broadcast(best)).select("setting", "w", "cap", "auc", (F.col("setting") == F.col("best")).alias("best")), "auc")


def gate_sweep(spark, d):
    """Scores made of findings, a biomarker of small units left out by an intervention: 10 - the capped sum of impacts."""
    u = units(spark, d).select("unit_id", "size", "defects")
    per = findings(spark, d).groupBy("unit_id").agg(F.sum(F.when(F.col("biomarker") == "NO", F.col("impact")).otherwise(0.0)).alias("gated"), F.sum(F.when(F.col("biomarker") != "NO", F.col("impact")).otherwise(0.0)).alias("rest"))
    grid = spark.createDataFrame([(f,) for f in FLOORS], "floor int")
    both = u.join(per, "unit_id", "left").fillna(0.0, ["gated", "rest"]).crossJoin(F.broadcast(grid))
    risk = F.least(F.lit(10.0), 5 * (F.col("rest") + F.when(F.col("size") < F.col("floor"), 0.0).otherwise(F.col("gated"))))
    return _rounded(R.auc(both, ["floor"], F.round(risk, 6), POSITIVE), "auc")


def label_comparison(spark, d):
    """AUC and Popt under two label strategies."""
    u = units(spark, d)
    both = u.withColumn("strategy", F.lit("plain")).unionByName(u.withColumn("defects", F.col("strict")).withColumn("strategy", F.lit("strict")))
    a, p = R.auc(both, ["strategy"], RISK, POSITIVE), R.popt(both, ["strategy"], "score").select("strategy", "popt")
    return _rounded(a.join(p, "strategy"), "auc", "popt")


def label_overlay(spark, d):
    """A strategy's labels over the units, absent ones 0, and by which strategy a unit is labelled."""
    u = units(spark, d).select("unit_id", "cluster")
    labels = units(spark, d).where("strict > 0").select(F.col("unit_id").alias("k"), F.col("strict").alias("defect_count"))
    out = u.join(labels, u["unit_id"] == labels["k"], "left").drop("k")
    return out.select("unit_id", "cluster", F.coalesce("defect_count", F.lit(0)).alias("defect_count"), F.when(F.col("defect_count").isNull(), "keyword").otherwise("szz").alias("strategy"))


def per_language_summary(spark, d):
    per = R.auc(units(spark, d), ["stratum", "cluster"], RISK, POSITIVE, degenerate=None)
    return _rounded(per.groupBy("stratum").agg(F.count("auc").alias("clusters"), F.avg("auc").alias("mean_auc"), F.min("auc").alias("least"), F.max("auc").alias("most")), "mean_auc", "least", "most")


def language_autopsy(spark, d):
    u = units(spark, d)
    counts = findings(spark, d).groupBy("unit_id").agg(F.count("*").alias("f"))
    middle = u.agg(F.median("size").alias("middle"))
    j = u.join(counts, "unit_id", "left").fillna(0, ["f"]).crossJoin(F.broadcast(middle))
    base = j.groupBy("stratum").agg(
        F.avg(F.expr(POSITIVE).cast("int")).alias("rate"), F.median("size").alias("median_size"), F.avg("f").alias("mean_findings"), F.avg((F.col("f") == 0).cast("int")).alias("no_findings")
    )
    slices = j.withColumn("slice", F.when(F.col("size") <= F.col("middle"), "small").otherwise("large"))
    both = slices.unionByName(slices.withColumn("slice", F.lit("all")))
    a = R.auc(both, ["stratum", "slice"], RISK, POSITIVE)
    wide = a.groupBy("stratum").agg(*(F.max(F.when(F.col("slice") == s, F.col("auc"))).alias(f"auc_{s}") for s in ("all", "small", "large")))
    return _rounded(base.join(wide, "stratum"), "rate", "median_size", "mean_findings", "no_findings", "auc_all", "auc_small", "auc_large")


WF = WITH + FINDINGS_SQL + ", "
_CAT = "case when score >= 8 then 'healthy' when score < 4 then 'alert' else 'warning' end"
_BAND = """b as (select *, case when size <= q1 then 'Q1' when size <= q2 then 'Q2' when size <= q3 then 'Q3' else 'Q4' end as band
  from u, (select quantile_cont(size, 0.25) as q1, quantile_cont(size, 0.5) as q2, quantile_cont(size, 0.75) as q3 from u))"""
_MW = "r(biomarker) as (values " + ", ".join(f"('{b}')" for b in ROSTER) + """),
h as (select distinct unit_id, biomarker from f),
g as (select r.biomarker, defects as v, count(*) as t, count(h.unit_id) as a from r cross join u left join h on h.unit_id = u.unit_id and h.biomarker = r.biomarker group by 1, 2),
w as (select *, t - a as b, sum(t - a) over (partition by biomarker order by v) as below from g),
m as (select biomarker, sum(a)::bigint as n, sum(b)::bigint as m, sum(a * v) as av, sum(b * v) as bv, sum(a * (2 * below - b)) as u2, sum(t * t * t - t)::double as ties from w group by 1),
x as (select biomarker, n as n_with, m as n_without, coalesce(av::double / nullif(n, 0), 0) as mean_with, coalesce(bv::double / nullif(m, 0), 0) as mean_without,
  case when n >= 3 and m >= 3 then u2 / 2.0::double end as u, case when n = 0 or m = 0 then 0.0 else u2::double / (n::double * m) - 1 end as delta,
  case when n >= 3 and m >= 3 then (u2 / 2.0::double - n::double * m / 2 - 0.5) / sqrt(n::double * m / 12 * ((n + m + 1) - ties / ((n + m)::double * (n + m - 1)))) end as z from m)"""
def _kruskal_sql(group: str) -> str:
    """p is 1 less the integral of 2 y^(k-1) exp(-y^2 / 2) / (2^(k/2) gamma(k/2)), k = groups - 1, from 0 to sqrt(h)."""
    step, weight = "(sqrt(h) / 2000)", "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"sum({weight} * 2 * ((i * {step}) ** (groups - 2)) * exp(-((i * {step}) ** 2) / 2)) * any_value({step}) / 3"
    tail = f"1 - {area} / exp(any_value(groups - 1) / 2.0::double * ln(2) + lgamma(any_value(groups - 1) / 2.0::double))"
    return f"""g as (select cluster, {group} as g, defects,
  rank() over (partition by cluster order by defects) + (count(*) over (partition by cluster, defects) - 1) / 2.0::double as r from u),
s as (select cluster, g, sum(r)::double as s, count(*) as m from g group by 1, 2),
h as (select cluster, count(*) as groups, sum(m)::double as n, sum(s * s / m) as q from s group by 1),
t as (select cluster, sum(c * c * c - c)::double as t from (select cluster, defects, count(*) as c from u group by 1, 2) group by 1),
x as (select cluster, groups, case when groups >= 2 and t < n * n * n - n then (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) end as h from h join t using (cluster)),
pt as (select cluster, {tail} as p from x, range(2001) r(i) where h is not null group by cluster)
select cluster, groups, round(h, 6) as h, round(p, 6) as p from x left join pt using (cluster)"""


SQL = {
    "density_ratio": WITH + """x as (select cluster, count(*) filter (score < 4) as low_n, count(*) filter (score > 8) as high_n,
  coalesce(avg(defects) filter (score < 4), 0) as a, coalesce(avg(defects) filter (score > 8), 0) as b,
  coalesce(1000.0 * sum(defects) filter (score < 4) / nullif(sum(size) filter (score < 4), 0), 0)::double as c,
  coalesce(1000.0 * sum(defects) filter (score > 8) / nullif(sum(size) filter (score > 8), 0), 0)::double as d from u group by 1)
select cluster, low_n, high_n, round(a, 6) as low_mean, round(b, 6) as high_mean, round(c, 6) as low_per_k, round(d, 6) as high_per_k,
  case when b = 0 then 'inf'::double else round(a / b, 6) end as ratio, case when d = 0 then 'inf'::double else round(c / d, 6) end as per_k_ratio from x""",
    "density_by_bucket": WITH + """k(pos, bucket, lo, hi) as (values (0, '[0-4)', 0, 4), (1, '[4-6)', 4, 6), (2, '[6-8)', 6, 8), (3, '[8-10]', 8, 10)),
x as (select bucket, count(unit_id) as files, coalesce(sum(defects), 0)::bigint as defects, coalesce(sum(size), 0) as s from k left join u
  on score >= lo and (score < hi or (pos = 3 and score <= hi)) group by pos, bucket)
select bucket, files, defects, round(coalesce(defects::double / nullif(files, 0), 0), 6) as mean_defects, round(coalesce(1000.0::double * defects / nullif(s, 0), 0), 6) as per_k from x""",
    "category_stats": WITH + f"x as (select cluster, {_CAT} as category, count(*) as files, round(avg(defects), 6) as mean_defects, round(coalesce(1000.0::double * sum(defects) / nullif(sum(size), 0), 0), 6) as per_k from u group by 1, 2) select * from x",
    "category_ratio": WITH + f"""x as (select cluster, {_CAT} as c, avg(defects) as m, coalesce(1000.0::double * sum(defects) / nullif(sum(size), 0), 0) as k from u group by 1, 2),
y as (select cluster, max(m) filter (c = 'alert') as am, max(m) filter (c = 'healthy') as hm, max(k) filter (c = 'alert') as ak, max(k) filter (c = 'healthy') as hk from x group by 1)
select cluster, round(case when hm > 0 then am / hm end, 6) as per_file, round(case when hk > 0 then ak / hk end, 6) as per_k from y""",
    "colour_groups": WITH + """k(colour) as (values ('red'), ('yellow'), ('green')), s as (select *, case when score >= 8 then 'green' when score >= 4 then 'yellow' else 'red' end as colour from u where size < 500)
select colour, count(unit_id) as n, round(coalesce(avg(defects), 0), 6) as mean from k left join s using (colour) group by 1""",
    "descriptive": WITH + """x as (select cluster, count(*) as n, count(*) filter (defects > 0) as n_positive, round(100.0::double * count(*) filter (defects = 0) / count(*), 6) as pct_zero,
  round(avg(defects), 6) as mean, round(median(defects), 6)::double as median, min(defects) as min, max(defects) as max, round(coalesce(stddev_samp(defects), 0), 6) as std, sum(defects)::bigint as sum from u group by 1) select * from x""",
    "kruskal_h": WITH + _kruskal_sql("case when score >= 8 then 'green' when score >= 4 then 'yellow' else 'red' end"),
    "kruskal_many": WITH + _kruskal_sql("unit_id % 7"),
    "mannwhitney_small": "with recursive" + WITH.removeprefix("with") + """a as (select cluster, stratum, unit_id % 4 = 0 as f, rival as v,
  rank() over (partition by cluster, stratum order by rival) + (count(*) over (partition by cluster, stratum, rival) - 1) / 2.0::double as r from u),
t as (select cluster, stratum, sum(c * c * c - c)::double as ties from (select cluster, stratum, v, count(*) as c from a group by all) group by 1, 2),
s as (select cluster, stratum, count(*) filter (f) as n, count(*) filter (not f) as m, sum(r) filter (f) - count(*) filter (f) * (count(*) filter (f) + 1) / 2.0::double as u from a group by 1, 2),
w(i, c, x, ways) as (select 0, 0, 0, 1.0::double union all  -- of i values in order c are the first's, x of the others' come before them
  select i + 1, c2, x2, sum(ways) from (select i, c + 1 as c2, x + (i - c) as x2, ways from w where c < 8 union all select i, c, x, ways from w)
  where i < (select max(n + m) from s) group by all),
g as (select cluster, stratum, n, m, u, ties, least(n, m) <= 8 and ties = 0 as exact from s join t using (cluster, stratum) where least(n, m) >= 2),
e as (select cluster, stratum, sum(ways) filter (x >= u) / sum(ways) as p from g join w on i = n + m and c = n where exact group by 1, 2),
z as (select cluster, stratum, (u - n * m / 2.0::double - 0.5) / sqrt(n * m / 12.0::double * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))) as z from g where not exact), """
    + upper_tail_sql("z", "cluster, stratum") + """
select s.cluster, s.stratum, s.n, s.m, round(g.u, 6) as u, g.exact, round(coalesce(e.p, pt.tail), 6) as p from s left join g using (cluster, stratum) left join e using (cluster, stratum) left join pt using (cluster, stratum)""",
    "cliffs_delta_by_biomarker": WF + _MW + " select biomarker, n_with, n_without, round(mean_with, 6) as mean_with, round(mean_without, 6) as mean_without, u, round(delta, 6) as delta, round(z, 6) as z from x",
    "mannwhitney_p": WF + _MW + ", " + upper_tail_sql("x", "biomarker") + " select biomarker, u, round(tail, 6) as p from x left join pt using (biomarker)",
    "biomarker_ranking": WF + _MW + " select row_number() over (order by round(delta, 6) desc, list_position([" + ", ".join(f"'{b}'" for b in ROSTER) + "], biomarker))::int as rank, biomarker, round(delta, 6) as delta from x",
    "dominant_biomarker": WF + """p as (select unit_id, biomarker, sum(case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 1 end) as w,
  sum(abs(impact)) as i, min(ord) as o, count(*) as c from f group by 1, 2),
q as (select unit_id, sum(w)::bigint as weighted, sum(i) as impact, sum(c)::bigint as findings, (list(biomarker order by round(i, 9) desc, o))[1] as dominant from p group by 1)
select u.unit_id, coalesce(weighted, 0) as weighted, round(coalesce(impact, 0), 6) as impact, coalesce(findings, 0) as findings, coalesce(dominant, '<none>') as dominant from u left join q on q.unit_id = u.unit_id""",
    "findings_per_file": WF + "c as (select unit_id, count(*) as n from f group by 1) select u.unit_id, cluster, coalesce(n, 0) as finding_count from u left join c on c.unit_id = u.unit_id",
    "max_magnitude": "with " + FINDINGS_SQL + " select unit_id, biomarker, max(magnitude) as magnitude from f where magnitude > 0 group by 1, 2",
    "fingerprint": WF + """c as (select cluster, biomarker, count(*) as n from f join u on u.unit_id = f.unit_id where defects > 0 group by 1, 2),
r as (select *, row_number() over (partition by cluster order by n desc, biomarker) as k from c)
select cluster, string_agg(n || 'x' || biomarker, ', ' order by k) as fingerprint from r where k <= 5 group by 1""",
    "nloc_quartiles": WITH + "x as (select round(quantile_cont(size, 0.25), 6)::double as q1, round(quantile_cont(size, 0.5), 6)::double as q2, round(quantile_cont(size, 0.75), 6)::double as q3 from u) select * from x",
    "auc_by_band": WITH + _BAND + ", " + _auc_sql("band", source="b"),
    "band_zscore": WITH + _BAND + ", x as (select *, avg(score) over w as m, stddev_pop(score) over w as s from b window w as (partition by cluster, band)) select unit_id, cluster, band, round(case when s <= 1e-9 then 0.0 else (score - m) / s end, 6) as z from x",
    "band_rank": WITH + _BAND + " select unit_id, round((row_number() over (partition by cluster, band order by score, ord) - 1)::double / greatest(count(*) over (partition by cluster, band) - 1, 1), 6) as rank from b",
    "size_residual": WITH + """l as (select unit_id, cluster, 10 - score as y, ln(1 + size::double) as x from u),
c as (select cluster, regr_slope(y, x) as a, regr_intercept(y, x) as b, stddev_pop(x) as sx, stddev_pop(y) as sy from l group by 1)
select unit_id, l.cluster, round(case when sx < 1e-9 or sy < 1e-9 then y else y - a * x - b end, 6) as residual from l join c on l.cluster = c.cluster""",
    "residual_auc": WITH + """l as (select cluster, defects, 10 - score as y, ln(1 + size::double) as x from u), c as (select regr_slope(y, x) as a, regr_intercept(y, x) as b from l),
e as (select cluster, defects, round(y - a * x - b, 9) as res from l, c), """ + _auc_sql("cluster", source="e", risk="res"),
    "leave_cluster_out": WITH + """k as (select distinct cluster as k from u), e as (select k, 10 - score as r, defects > 0 as y, cluster = k as own from u, k),
r as (select *, rank() over (partition by k, own order by r) * 2 + count(*) over (partition by k, own, r) - 1 as r2 from e),
a as (select k, own, count(*) as n, count(*) filter (y) as p, sum(r2) filter (y) as s from r group by 1, 2),
v as (select k, own, n, p, (s - p * (p + 1))::double / nullif(2.0::double * p * (n - p), 0) as auc from a)
select k as cluster, max(n) filter (own) as n, max(p) filter (own) as positives, round(max(auc) filter (own), 6) as auc_within, round(max(auc) filter (not own), 6) as auc_without from v group by 1""",
    "worst_false_positives": WITH + "x as (select * from u where defects = 0 order by score, ord limit 25) select unit_id, score, size from x",
    "worst_false_negatives": WITH + "x as (select * from u where defects > 0 order by score desc, defects desc, ord limit 25) select unit_id, score, defects from x",
    "coverage_penalty_grid": WITH + "g(setting, w, cap) as (values " + ", ".join(f"({i}, {w}::double, {c}::double)" for i, (w, c) in enumerate(SETTINGS)) + """),
e as (select setting, w, cap, defects, round(least(10.0, 10 - score + least(cap, w * greatest(0.0, (100 - (unit_id * 37) % 101) / 100.0::double))), 6) as risk from u, g), """
    + _auc_sql("setting, w, cap", source="e", risk="risk").rsplit("\nselect", 1)[0]
    + """, y as (select setting, w, cap, (s - n_pos * (n_pos + 1))::double / (2.0::double * n_pos * (n - n_pos)) as auc from a)
select setting, w, cap, round(auc, 6) as auc, setting = (select setting from y order by round(auc, 9) desc, setting limit 1) as best from y""",
    "gate_sweep": WF + "g(floor) as (values " + ", ".join(f"({f})" for f in FLOORS) + """), p as (select unit_id, sum(case when biomarker = 'NO' then impact else 0 end) as gated, sum(case when biomarker <> 'NO' then impact else 0 end) as rest from f group by 1),
e as (select floor, defects, round(least(10.0, 5 * (coalesce(rest, 0) + case when size < floor then 0.0 else coalesce(gated, 0) end)), 6) as risk from u left join p on p.unit_id = u.unit_id, g), """
    + _auc_sql("floor", source="e", risk="risk"),
    "label_overlay": WITH + "x as (select unit_id, cluster, strict as defect_count, case when strict > 0 then 'szz' else 'keyword' end as strategy from u) select * from x",
    "label_comparison": WITH + "b as (select *, 'plain' as strategy from u union all select * replace (strict as defects), 'strict' from u), "
    + _auc_sql("strategy", source="b").rsplit("\nselect", 1)[0] + ", x1 as (select" + _auc_sql("strategy", source="b").rsplit("\nselect", 1)[1] + "), "
    + popt_sql("strategy", source="b", final=" select x1.*, round(popt, 6) as popt from x1 join pp using (strategy)"),
    "per_language_summary": WITH + _auc_sql("stratum, cluster", "null").rsplit("\nselect", 1)[0]
    + """, y as (select stratum, case when n_pos in (0, n) then null else (s - n_pos * (n_pos + 1))::double / (2.0::double * n_pos * (n - n_pos)) end as auc from a)
select stratum, count(auc) as clusters, round(avg(auc), 6) as mean_auc, round(min(auc), 6) as least, round(max(auc), 6) as most from y group by 1""",
}
_LO = SQL["leave_cluster_out"].split("\nselect k as cluster")[0]
SQL["cluster_cost"] = _LO + """,
o as (select k as cluster, max(n) filter (own) as n, max(p) filter (own) as positives, max(auc) filter (own) as w, max(auc) filter (not own) as wo from v group by 1),
rr as (select defects > 0 as y, rank() over (order by 10 - score) * 2 + count(*) over (partition by score) - 1 as r2 from u),
al as (select (sum(r2) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1))::double / (2.0::double * count(*) filter (y) * count(*) filter (not y)) as a from rr),
mm as (select cluster, avg(size) as ms, avg(10 - score) as mr, avg((defects > 0)::int) as rate from u group by 1)
select cluster, n, positives, round(rate, 6) as rate, round(w, 6) as auc_within, round(wo - a, 6) as delta, round(ms, 6) as mean_size, round(mr, 6) as mean_risk from o join mm using (cluster), al"""
SQL["language_autopsy"] = WF + """c as (select unit_id, count(*) as n from f group by 1), md as (select median(size) as m from u),
j as (select u.*, coalesce(n, 0) as f, case when size <= m then 'small' else 'large' end as slice from u left join c on c.unit_id = u.unit_id, md),
b as (select stratum, slice, score, defects from j union all select stratum, 'all', score, defects from j), """ + _auc_sql("stratum, slice", source="b").rsplit("\nselect", 1)[0] + ", x1 as (select" + _auc_sql("stratum, slice", source="b").rsplit("\nselect", 1)[1] + """),
x2 as (select stratum, max(auc) filter (slice = 'all') as auc_all, max(auc) filter (slice = 'small') as auc_small, max(auc) filter (slice = 'large') as auc_large from x1 group by 1),
x3 as (select stratum, round(avg((defects > 0)::int), 6) as rate, round(median(size), 6)::double as median_size, round(avg(f), 6) as mean_findings, round(avg((f = 0)::int), 6) as no_findings from j group by 1)
select * from x3 join x2 using (stratum)"""

QUERIES = {
    f.__name__: f
    for f in (
        density_ratio, density_by_bucket, category_stats, category_ratio, colour_groups, descriptive, kruskal_h, kruskal_many, mannwhitney_small, cliffs_delta_by_biomarker, mannwhitney_p, biomarker_ranking,
        dominant_biomarker, findings_per_file, max_magnitude, fingerprint, nloc_quartiles, auc_by_band, band_zscore, band_rank, size_residual, residual_auc, leave_cluster_out,
        cluster_cost, worst_false_positives, worst_false_negatives, coverage_penalty_grid, gate_sweep, label_comparison, label_overlay, per_language_summary, language_autopsy,
    )
}
