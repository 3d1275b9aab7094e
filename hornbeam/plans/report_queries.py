"""Registered reports of many metrics at once, with their DuckDB equivalents made of those of the single metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import groups as G
from hornbeam.operators.bundle import metric_bundle
from hornbeam.operators.gates import Intervention, Rules, gate_table
from hornbeam.operators.inference import PRIME
from hornbeam.plans import group_queries, rank_queries
from hornbeam.plans.group_queries import ROSTER
from hornbeam.plans.inference_queries import _drawn_sql, _weighted_auc
from hornbeam.plans.rank_queries import WITH, _auc_sql, _ranks, corr_sql, effort_sql, popt_sql
from hornbeam.sources.tables import FINDINGS_SQL, findings, read, units

#: Metrics of the bundle by the query whose SQL tells them, and their names there.
TOLD = {
    "auc_by_cluster": {"auc": "auc"}, "spearman": {"rho": "rho", "rho_p": "p"}, "partial_spearman": {"partial": "partial"}, "popt_by_cluster": {"popt": "popt"},
    "effort20_by_cluster": {k: k for k in ("files", "inspected", "precision", "recall_defects", "recall_files")},
    "density_ratio": {k: k for k in ("low_mean", "high_mean", "ratio", "low_per_k", "high_per_k", "per_k_ratio")}, "kruskal_h": {"kruskal_h": "h", "kruskal_p": "p"},
    "descriptive": {f"defects_{k}": k for k in ("mean", "median", "min", "max", "std")},
}
SCORES = {"score_mean": "avg(score)", "score_median": "median(score)", "score_min": "min(score)", "score_max": "max(score)", "score_std": "coalesce(stddev_samp(score), 0)"}


def _long(df, by):
    names = [k for q in TOLD.values() for k in q] + ["hits_k", "precision_k", *SCORES]
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), F.round(F.col(k).cast("double"), 6).alias("value")) for k in names))
    return df.select(*by, F.inline(pairs)).select(*by, "metric", "value")


def metric_report(spark, d):
    """Every metric of every cluster, a row for each."""
    return _long(metric_bundle(units(spark, d), ["cluster"], low=4.0), ["cluster"])


def corpus_report(spark, d):
    """Every metric of all units together, with each biomarker's effect size and p and each score bucket's density."""
    u = units(spark, d)
    marks = G.with_without(u, findings(spark, d), ROSTER, "defects").select("biomarker", "delta", G.normal_tail(F.col("z")).alias("p"))
    marks = marks.select(F.inline(F.array(*(F.struct(F.concat(F.lit(f"{k}_"), F.col("biomarker")).alias("metric"), F.round(k, 6).alias("value")) for k in ("delta", "p")))))
    buckets = G.density_by_bucket(u)
    buckets = buckets.select(F.inline(F.array(*(F.struct(F.concat(F.lit(f"{k}_"), F.col("bucket")).alias("metric"), F.round(k, 6).alias("value")) for k in ("mean_defects", "per_k")))))
    return _long(metric_bundle(u, [], low=4.0), []).unionByName(marks).unionByName(buckets)


def temporal_metrics(spark, d):
    """Metrics of an event's value for a purchase in overlapping windows of 14 days that begin every 5, null below 4 rows or
    without a purchase.  An event is in three windows at most."""
    e = read(spark, d, "events").select(
        (-F.round("value", 6)).alias("score"), F.get_json_object("props", "$.k").cast("long").alias("size"), (F.col("event_type") == "purchase").cast("long").alias("defects"), F.col("event_id").alias("ord"), "ts"
    )
    starts = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-26', interval 5 days)) as t0")  # six rows
    x = e.join(F.broadcast(starts), (F.col("ts") >= F.col("t0")) & (F.col("ts") < F.col("t0") + F.expr("interval 14 days"))).withColumn("t0", F.date_format("t0", "yyyy-MM-dd"))
    # the slice of few events has windows below 4 rows
    x = x.withColumn("slice", F.when(F.pmod("ord", F.lit(997)) == 0, "few").otherwise("rest"))
    names = ("auc", "popt", "partial", "precision", "recall_defects", "recall_files")
    return metric_bundle(x, ["slice", "t0"], least=4).select("slice", "t0", "n", "n_pos", *(F.round(c, 6).alias(c) for c in names))


RULES = Rules(
    (("RF", "structure", 0.5), ("AF", "structure", 0.4), ("NF", "style", 0.3), ("NO", "size", 0.25), ("RO", "size", 0.2)),
    {"structure": 3.0, "style": 1.5, "size": 2.5},
)
INTERVENTIONS = [
    Intervention("baseline"), Intervention("drop NO <600", "NO", 600), Intervention("drop NO <750", "NO", 750), Intervention("drop NO <900", "NO", 900), Intervention("drop NO <Q2", "NO", 768),
    Intervention("drop NO ALL", "NO", float("inf")), Intervention("drop NF <Q2", "NF", 768), Intervention("drop NF ALL", "NF", float("inf")), Intervention("drop AF <Q2", "AF", 768),
]
BANDS, GATE_REPS = [600.0, 768.0, 950.0], 400


def gate_experiment(spark, d):
    """Nine interventions on scores made of findings."""
    t = gate_table(units(spark, d), findings(spark, d), RULES, INTERVENTIONS, BANDS, GATE_REPS, "99")
    return t.select("intervention", *(F.round(c, 6).alias(c) for c in t.columns if c != "intervention"))


def _gate_sql() -> str:
    weight = "case severity when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 1 end"
    paid = ", ".join(f"coalesce(sum({weight}) filter (biomarker = '{b}'), 0)::double as d{i}" for i, (b, _, _) in enumerate(RULES.deductions))
    ways = []
    for w in INTERVENTIONS:
        parts = []
        for category, cap in RULES.caps.items():
            costs = [f"case when size < '{w.floor}'::double then 0 else d{i} * {c}::double end" if b == w.biomarker else f"d{i} * {c}::double" for i, (b, k, c) in enumerate(RULES.deductions) if k == category]
            parts.append(f"least({cap}::double, " + " + ".join(costs) + ")")
        ways.append(f"select '{w.label}' as intervention, unit_id, cluster, ord, size, defects, round(greatest(1.0::double, 10.0::double - (" + " + ".join(parts) + ")), 6) as score from uf")
    head = WITH + FINDINGS_SQL + f""", pf as (select unit_id, {paid} from f group by 1),
uf as (select u.* exclude (score), {', '.join(f'coalesce(d{i}, 0) as d{i}' for i in range(len(RULES.deductions)))} from u left join pf using (unit_id)),
sc as (select *, 10 - score as risk, case when size <= 600 then 1 when size <= 768 then 2 when size <= 950 then 3 else 4 end as band from ({' union all '.join(ways)})), """
    auc = lambda by, none: head + _auc_sql(by, none, "sc", "risk")
    draw = f"len(list_filter(t, lambda v: v <= (ha + rep * hb) % {PRIME}))"
    boot = head + f"""ce as (select a.intervention, b.risk as base, a.risk, (a.defects > 0)::int as defects, count(*) as n, min(a.ord) as ord from sc a join sc b on b.unit_id = a.unit_id and b.intervention = 'baseline' group by 1, 2, 3, 4), """ + _drawn_sql("ce", "99") + f""",
ds as (select intervention, rep, base, risk, defects, {draw} as weight from cx, range({GATE_REPS}) r(rep)), """ + _weighted_auc("intervention, rep", "ds", "risk", "null").replace("g as (", "g1 as (").replace("from g)", "from g1)").replace("c as (", "c1 as (").replace("from c group", "from c1 group").replace("per as (", "pa as (") + ", " + _weighted_auc("intervention, rep", "ds", "base", "null").replace("per as (", "pb as (") + """,
m as (select intervention, list(round(pa.auc - pb.auc, 9) order by round(pa.auc - pb.auc, 9)) as v, avg(round(pa.auc - pb.auc, 9)) as delta from pa join pb using (intervention, rep) where pa.auc is not null group by 1)
select intervention, round(delta, 6) as delta, round(v[floor(0.025 * len(v))::int + 1], 6) as lo, round(v[floor(0.975 * len(v))::int + 1], 6) as hi from m"""
    return f"""with ga as (select intervention, auc as corpus_auc from ({auc("intervention", "0.5")})),
gc as (select intervention, cluster, auc from ({auc("intervention, cluster", "null").replace("round(case", "(case").replace("end, 6)", "end)")}) where auc is not null),
gp as (select intervention, cluster, popt from ({head + popt_sql("intervention, cluster", source="sc", final="select intervention, cluster, popt from pp")})),
gm as (select intervention, round(avg(auc), 6) as mean_auc, round(avg(popt), 6) as mean_popt from gc join gp using (intervention, cluster) group by 1),
gb as (select intervention, {', '.join(f'max(auc) filter (band = {i}) as band_{i}' for i in (1, 2, 3, 4))} from ({auc("intervention, band", "null")}) group by 1),
gd as ({boot})
select * from ga left join gm using (intervention) left join gb using (intervention) left join gd using (intervention)"""


def _report_sql(whole: bool) -> str:
    """One metric after another from the SQL of its own query; for all units together the cluster is one and the same."""
    known = rank_queries.SQL | group_queries.SQL
    one = (lambda sql: sql.replace("p_brand as cluster", "'all' as cluster")) if whole else (lambda sql: sql)
    keys = "" if whole else "cluster, "
    parts = [f"select {keys}'{k}' as metric, {c}::double as value from ({one(known[q])})" for q, names in TOLD.items() for k, c in names.items()]
    low = "lk as (select cluster, defects, row_number() over (partition by cluster order by score, size, ord) as rn from (select cluster, score, greatest(size, 1) as size, ord, defects from u))"
    for k, v in {"hits_k": "count(*) filter (defects > 0)", "precision_k": "count(*) filter (defects > 0)::double / count(*)"}.items():
        parts.append(f"select {keys}'{k}', round({v}, 6)::double from ({one(WITH)} {low} select * from lk where rn <= 20) group by cluster")
    parts += [f"select {keys}'{k}', round({v}, 6)::double from ({one(WITH)} x as (select * from u) select * from x) group by cluster" for k, v in SCORES.items()]
    if whole:
        parts += [f"select '{k}_' || biomarker, {k} from ({known[q]})" for k, q in (("delta", "cliffs_delta_by_biomarker"), ("p", "mannwhitney_p"))]
        parts += [f"select '{k}_' || bucket, {k} from ({known['density_by_bucket']})" for k in ("mean_defects", "per_k")]
    return " union all ".join(parts)


QUERIES = {f.__name__: f for f in (metric_report, corpus_report, temporal_metrics, gate_experiment)}
_EVENTS = """with u as (select strftime(t0, '%Y-%m-%d') as t0, case when event_id % 997 = 0 then 'few' else 'rest' end as slice, -round(value, 6) as score, (props->>'$.k')::bigint as size,
  (event_type = 'purchase')::bigint as defects, event_id as ord from events, (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-26', interval 5 days)) as t0) where ts >= t0 and ts < t0 + interval 14 days), """
_BY = "slice, t0"
_TEMPORAL = (
    _EVENTS + _auc_sql(_BY, risk="-score").rsplit("\nselect", 1)[0] + ", x1 as (select" + _auc_sql(_BY, risk="-score").rsplit("\nselect", 1)[1] + "), " + popt_sql(_BY, final=f", x2 as (select {_BY}, popt from pp), ")
    + effort_sql(_BY, final=f", x3 as (select {_BY}, p, rd, rf from ee), ")
    + f"""rk as (select {_BY}, {_ranks({"score": "x", "defects": "y", "size": "z"}, _BY)} from u),
ck as (select {_BY}, {corr_sql("x", "y")} as a, {corr_sql("x", "z")} as b, {corr_sql("y", "z")} as c from rk group by all)
select slice, t0, n, n_pos, case when n >= 4 and n_pos > 0 then auc end as auc, case when n >= 4 and n_pos > 0 then round(popt, 6) end as popt,
  case when n >= 4 and n_pos > 0 then round(case when sqrt((1 - b * b) * (1 - c * c)) = 0 then 0.0 else (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) end, 6) end as partial,
  case when n >= 4 and n_pos > 0 then round(p, 6) end as precision, case when n >= 4 and n_pos > 0 then round(rd, 6) end as recall_defects, case when n >= 4 and n_pos > 0 then round(rf, 6) end as recall_files
from x1 left join x2 using (slice, t0) left join x3 using (slice, t0) left join ck using (slice, t0)"""
)

SQL = {"gate_experiment": _gate_sql(), "temporal_metrics": _TEMPORAL, "metric_report": _report_sql(False), "corpus_report": _report_sql(True)}
