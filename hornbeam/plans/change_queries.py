"""Registered queries on changes, time windows, paired runs, tokens and event streams, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import changes as C
from hornbeam.operators import paired as P
from hornbeam.operators import ranking as R
from hornbeam.operators.tokens import read_ranks, tokens_per_text
from hornbeam.plans.rank_queries import _auc_sql, _rounded
from hornbeam.sources.tables import COMMITS_SQL, FILES_SQL, commit_files, commits, read

A, B = "click", "view"


def commit_features(spark, d):
    return _rounded(C.features(commit_files(spark, d)), "entropy")


def change_entropy(spark, d):
    f = C.features(commit_files(spark, d))
    return _rounded(f.groupBy("nf").agg(F.count("*").alias("n"), F.avg("entropy").alias("mean_entropy"), F.max("entropy").alias("max_entropy")), "mean_entropy", "max_entropy")


def numstat_lines(spark, d):
    """Numstat rows written from the lines of all orders: binary files, malformed counts and broken rows among them."""
    kind = F.pmod("l_suppkey", F.lit(5))
    added = F.when(kind == 1, "-").when(kind == 2, "x").otherwise(F.col("l_quantity").cast("int").cast("string"))
    path = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"))
    tab = F.when(kind == 3, " ").otherwise("\t")
    row = F.concat(added, tab, F.when(kind == 1, "-").otherwise(F.col("l_linenumber").cast("string")), tab, path)
    v = read(spark, d, "lineitem").select(row.alias("line")).withColumn("n", C.numstat(F.col("line"))).where("n is not null")
    return v.groupBy("n.path").agg(F.count("*").alias("n"), F.sum("n.la").cast("long").alias("la"), F.sum("n.ld").cast("long").alias("ld"))


def author_experience(spark, d):
    return C.experience(commits(spark, d)).select("sha", "author", F.col("exp").cast("long").alias("exp"))


def right_censor(spark, d):
    c = C.right_censored(commits(spark, d), 180)
    return c.groupBy("priority").agg(F.count("*").alias("n"), F.max("ct").alias("last"))


def time_split(spark, d):
    s = C.time_split(commits(spark, d))
    return s.groupBy("priority").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


def jit_effort(spark, d):
    """Inspecting changes by churn: precision and recall within a fifth of all churn."""
    f = C.features(commit_files(spark, d)).join(commits(spark, d), "sha")
    f = f.withColumn("y", (F.col("priority") == "1-URGENT").cast("long")).withColumn("risk", F.col("churn").cast("double")).withColumn("ord", F.col("sha"))
    return _rounded(C.effort_by_score(f, ["priority"]).select("priority", "files", "inspected", "precision", "recall_defects"), "precision", "recall_defects")


def jit_auc(spark, d):
    """Each feature as a risk of a change being urgent."""
    f = C.features(commit_files(spark, d)).join(C.experience(commits(spark, d)), "sha")
    long = f.select("priority", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 9).alias("risk")) for c in ("la", "ld", "nf", "nd", "ns", "entropy", "exp")))).alias("x"))
    return _rounded(R.auc(long.select("priority", "x.*"), ["feature"], "risk", "priority = '1-URGENT'"), "auc")


def temporal_windows(spark, d):
    """AUC of an event's value for a purchase in overlapping windows of 14 days that begin every 5."""
    e = read(spark, d, "events")
    starts = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-26', interval 5 days)) as t0")
    x = e.join(F.broadcast(starts), (F.col("ts") >= F.col("t0")) & (F.col("ts") < F.col("t0") + F.expr("interval 14 days")))
    out = R.auc(x, ["t0"], F.round("value", 6), "event_type = 'purchase'")
    return _rounded(out.withColumn("t0", F.date_format("t0", "yyyy-MM-dd")), "auc")


def temporal_summary(spark, d):
    """Least, greatest, range and mean of the windows' values."""
    t = temporal_windows(spark, d)
    return _rounded(t.agg(F.count("auc").alias("windows"), F.min("auc").alias("least"), F.max("auc").alias("most"), (F.max("auc") - F.min("auc")).alias("range"), F.avg("auc").alias("mean")), "range", "mean")


def runs(spark, d):
    """Events as runs: a type is an arm, a user a task; of a task's events in an arm the last one counts."""
    e = read(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("arm"), F.col("event_id").alias("ord"), F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("double").alias("turns"))
    return P.last_row_wins(e, ["task", "arm"], "ord")


def last_row_wins(spark, d):
    return runs(spark, d)


def _arms(spark, d):
    types = ["click", "purchase"]
    return P.pairs(runs(spark, d), *types, ["cost", "turns"])


def paired_metrics(spark, d):
    return _rounded(P.metric_block(_arms(spark, d), ["cost", "turns"], higher_better=("turns",)), "mean_a", "mean_b", "median_a", "median_b", "delta_pct", "median_delta_pct")


def win_counts(spark, d):
    p = _arms(spark, d)
    return p.agg(F.count("*").alias("tasks"), F.count_if(F.col("b_cost") < F.col("a_cost")).alias("cheaper"), F.count_if(F.col("b_turns") < F.col("a_turns")).alias("shorter"), F.count_if(F.col("b_turns") >= F.col("a_turns")).alias("no_worse"))


def paired_totals(spark, d):
    p = _arms(spark, d)
    out = p.agg(F.sum("a_cost").alias("a"), F.sum("b_cost").alias("b"))
    return _rounded(out.withColumn("delta_pct", 100 * (F.col("b") - F.col("a")) / F.col("a")), "a", "b", "delta_pct")


def trimmed_mean(spark, d):
    p = _arms(spark, d).select(F.lit("cost").alias("metric"), "ord", F.round(F.col("b_cost") - F.col("a_cost"), 9).alias("delta"))
    return _rounded(P.trimmed_mean(p, ["metric"], "delta", "ord"), "trimmed")


def best_worst(spark, d):
    """The task with the greatest saving, the first of equals, and the least, the last of equals."""
    p = _arms(spark, d).withColumn("saved", F.round(F.col("a_cost") - F.col("b_cost"), 6))
    return p.agg(F.max_by("task", F.struct("saved", -F.col("ord"))).alias("best"), F.min_by("task", F.struct("saved", -F.col("ord"))).alias("worst"))


def delta_quantiles(spark, d):
    p = _arms(spark, d).withColumn("delta", F.col("b_cost") - F.col("a_cost"))
    return _rounded(p.agg(*(F.percentile("delta", q).alias(f"p{int(100 * q)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9))), "p10", "p25", "p50", "p75", "p90")


def turn_histogram(spark, d):
    return runs(spark, d).groupBy("arm", "turns").agg(F.count("*").alias("n"))


def judge_score(spark, d):
    """Scores of each order: both sides, one side null, an empty map or no map."""
    kind, price = F.pmod("o_orderkey", F.lit(4)), F.floor(F.col("o_totalprice") / 1000).cast("double")
    none = F.lit(None).cast("double")
    both = F.create_map(F.lit("a"), F.when(kind == 2, none).otherwise(price), F.lit("b"), F.pmod("o_custkey", F.lit(11)).cast("double"))
    scores = F.when(kind < 3, both).when(F.col("o_custkey") % 2 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("task"), P.judge_score(scores).alias("score"))


def resume_antijoin(spark, d):
    """Every task in every arm that has no run without an error yet."""
    r = runs(spark, d)
    tasks, arms = r.select("task").distinct(), spark.createDataFrame([("click",), ("purchase",), ("view",)], "arm string")
    done = r.where("turns <= 50").select("task", "arm")
    return tasks.crossJoin(F.broadcast(arms)).join(done, ["task", "arm"], "left_anti")


def budget_gate(spark, d):
    r = read(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("ord"), F.col("value").alias("cost"))
    b = P.budget(r, 500.0, 1.0, ["task"])
    return _rounded(b.groupBy("task").agg(F.count_if("allowed").alias("allowed"), F.max(F.when(F.col("allowed"), F.col("spent"))).alias("spent")), "spent")


def cost_model(spark, d):
    e = read(spark, d, "events")
    cost = P.cost_model(F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.col("value")), F.col("event_id"), F.col("user_id"), F.lit(1000))
    return _rounded(e.groupBy("event_type").agg(F.sum(cost).alias("cost")), "cost")


def tokens(spark, d):
    """Documents as commits: characters over 4 are a text's tokens, its length's remainders a diff's and a context's."""
    return _commits(read(spark, d, "documents"), F.floor(F.col("n_chars") / 4))


def _commits(docs, naive):
    t = docs.select(F.col("source").alias("repo"), naive.alias("naive"), F.pmod("n_chars", F.lit(97)).alias("diff"), F.pmod("n_chars", F.lit(53)).alias("context"))
    return t.withColumn("skipped", F.when(F.col("naive") < 100, "all-files-excluded").when(F.col("context") < 5, "undersized"))


def token_summary_rollup(spark, d):
    return _rounded(P.token_summary(tokens(spark, d)), "pooled_naive", "pooled_diff", "mean_ratio_naive", "mean_ratio_diff", "median_ratio", "max_ratio")


#: Ranks of a public byte-level vocabulary; any file of the form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_summary_bpe(spark, d, vocabulary=VOCABULARY):
    """As ``token_summary_rollup``, with a text's tokens counted by byte-pair merges."""
    docs = read(spark, d, "documents").select("source", "n_chars", "text")
    t = tokens_per_text(docs, read_ranks(spark, vocabulary), F.col("text")).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    return _rounded(P.token_summary(_commits(t, F.col("n_tokens"))), "pooled_naive", "pooled_diff", "mean_ratio_naive", "mean_ratio_diff", "median_ratio", "max_ratio")


def skip_reasons(spark, d):
    return tokens(spark, d).where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n"))


def repo_histogram(spark, d):
    return tokens(spark, d).groupBy("repo").agg(F.count("*").alias("n"))


def agent_lines(events):
    """Agent event streams made of events: a line of JSON for each, with broken lines between."""
    e = events.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), "event_type", "value")
    path = F.concat(F.lit("f"), (F.col("ord") % 5).cast("string"), F.lit(".py"))
    tool = F.when(F.col("ord") % 3 == 0, "Read").when(F.col("ord") % 3 == 1, "Edit").otherwise("Task")
    use = F.format_string('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"%s","input":{"file_path":"%s"}},{"type":"text"}]}}', tool, path)
    result = F.format_string('{"type":"result","total_cost_usd":%s,"num_turns":%s,"usage":{"input_tokens":%s,"output_tokens":2}}', F.col("value").cast("string"), (F.col("ord") % 9).cast("string"), F.col("ord").cast("string"))
    line = F.when(F.col("event_type") == "purchase", result).when(F.col("event_type") == "view", "{broken").otherwise(use)
    return e.select("run", "ord", line.alias("line"))


def stream_summary(spark, d):
    return _rounded(P.stream_summary(agent_lines(read(spark, d, "events"))), "cost")


def failure_reasons(spark, d):
    """What each user's stream of events tells of its failure: errors, failed results, retries, noise; else what was
    written to stderr."""
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"))
    rare = lambda by, told: F.pmod("ord", F.lit(by)) == told
    line = (
        F.when(rare(1009, 3), F.format_string('{"type":"system","subtype":"error","error":"stop %d"}', "ord"))
        .when(rare(1009, 5), F.format_string('{"type":"result","is_error":true,"result":"failed %d"}', "ord"))
        .when(rare(97, 7), F.format_string('{"type":"system","subtype":"retry","attempt":%d,"error":"again %d"}', F.pmod("ord", F.lit(3)), "ord"))
        .when(rare(2, 0), "not json").otherwise('{"type":"result","is_error":false,"result":"fine"}')
    )
    told = F.when(F.col("run") % 3 == 0, F.concat(F.lit("killed "), F.col("run").cast("string"))).otherwise("")
    return P.failure_reason(e.select("run", "ord", line.alias("line")), e.select("run").distinct().withColumn("stderr", told))


def fifo_pairs(spark, d):
    e = read(spark, d, "events").where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", "call").otherwise("result").alias("kind"))
    return P.fifo_pairs(e)


def resume_set(spark, d):
    """Keys of finished runs in a log of JSON lines, one for each event; broken, keyless and failed lines are not among
    them."""
    task, kind = F.col("user_id").cast("string"), F.pmod("event_id", F.lit(5))
    line = (
        F.when(kind == 0, "{oops").when(kind == 1, F.concat(F.lit('{"condition":"'), "event_type", F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"task_id":"'), task, F.lit('","condition":"'), "event_type", F.lit('","error":"e"}')))
        .otherwise(F.concat(F.lit('{"task_id":"'), task, F.lit('","condition":"'), "event_type", F.when(kind == 3, '","error":null}').otherwise('"}')))
    )
    v = read(spark, d, "events").select(F.from_json(line, "task_id string, condition string, error string").alias("r"))
    return v.where("r.task_id is not null and r.condition is not null and r.error is null").select("r.task_id", "r.condition").distinct()


def task_selection(spark, d):
    """Positions within a group: those listed to be in win over those listed to be out; then skip and limit."""
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    from pyspark.sql import Window

    at = n.withColumn("at", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    return at.where("n_regionkey in (0, 1, 2) and (at in (0, 2) or at not in (1, 3, 2))").orderBy("n_regionkey", "at").offset(2).limit(5).select("n_nationkey", F.col("at").cast("long").alias("at"))


def pr_signals(spark, d):
    """Signals of a pull request from its commits and reviews: an order's lines and its customer's events."""
    line = read(spark, d, "lineitem")
    per = line.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.unix_timestamp("l_shipdate"))).alias("commits"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", F.unix_timestamp("l_shipdate")))).alias("reviews"),
        F.count_if(F.col("l_returnflag") == "R").alias("changes_requested"), F.sum("l_quantity").cast("long").alias("changed_lines"), F.countDistinct("l_partkey").alias("changed_files"),
    )
    first = F.array_min("reviews")
    return per.select(
        "l_orderkey", F.round((F.array_max("commits") - F.array_min("commits")) / 3600.0, 4).alias("commit_span_h"), F.size("commits").cast("long").alias("n_commits"), F.size("reviews").cast("long").alias("review_rounds"), "changes_requested",
        F.size(F.filter("commits", lambda t: t > first)).cast("long").alias("commits_after_first_review"), F.round(F.try_divide(F.size("reviews"), F.col("changed_lines")), 6).alias("review_density"), "changed_lines", "changed_files",
    )


_FEAT = f"""with {COMMITS_SQL}, {FILES_SQL}, f as (select sha, path, sum(la) as la, sum(ld) as ld from cf group by 1, 2),
g as (select sha, sum(la)::bigint as la, sum(ld)::bigint as ld, count(*) as nf, count(distinct regexp_replace(path, '/[^/]*$', '')) as nd, count(distinct split_part(path, '/', 1)) as ns, sum(la + ld)::bigint as churn,
  log2(sum(la + ld)::double) - sum((la + ld) * log2((la + ld)::double)) / sum(la + ld) as entropy from f group by 1)"""
_WIN = """s as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-26', interval 5 days)) as t0),
x as (select strftime(t0, '%Y-%m-%d') as t0, value, event_type from events, s where ts >= s.t0 and ts < s.t0 + interval 14 days)"""
_RUNS = """ru as (select user_id as task, event_type as arm, event_id as ord, value as cost, (props->>'$.k')::double as turns from events),
rr as (select * from (select *, row_number() over (partition by task, arm order by ord desc) as k from ru where task is not null and arm is not null) where k = 1),
pr as (select task, max(cost) filter (arm = 'click') as a_cost, max(cost) filter (arm = 'purchase') as b_cost, max(turns) filter (arm = 'click') as a_turns, max(turns) filter (arm = 'purchase') as b_turns, min(ord) as ord
  from rr where arm in ('click', 'purchase') group by 1 having a_cost is not null and b_cost is not null and a_turns is not null and b_turns is not null)"""
_TOK = """t as (select source as repo, n_chars // 4 as naive, n_chars % 97 as diff, n_chars % 53 as context, case when n_chars // 4 < 100 then 'all-files-excluded' when n_chars % 53 < 5 then 'undersized' end as skipped from documents)"""
SQL = {
    "commit_features": _FEAT + " select sha, la, ld, nf, nd, ns, churn, round(entropy, 6) as entropy from g",
    "change_entropy": _FEAT + " select nf, count(*) as n, round(avg(entropy), 6) as mean_entropy, round(max(entropy), 6) as max_entropy from g group by 1",
    "numstat_lines": """select 'src/f' || l_partkey as path, count(*) as n, sum(case when l_suppkey % 5 in (1, 2) then 0 else l_quantity::int end)::bigint as la,
  sum(case l_suppkey % 5 when 1 then 0 else l_linenumber end)::bigint as ld from lineitem where l_suppkey % 5 <> 3 group by 1""",
    "author_experience": f"with {COMMITS_SQL} select sha, author, row_number() over (partition by author order by ct, sha) - 1 as exp from c",
    "right_censor": f"with {COMMITS_SQL} select priority, count(*) as n, max(ct) as last from c where ct <= (select max(ct) from c) - {180 * 86400} group by 1",
    "time_split": f"with {COMMITS_SQL}, x as (select priority, row_number() over (order by ct, sha) <= floor(0.7 * count(*) over ()) as train from c) select priority, count(*) filter (train) as train, count(*) filter (not train) as test from x group by 1",
    "jit_effort": _FEAT + """, h as (select g.*, priority, (priority = '1-URGENT')::bigint as y, greatest(churn, 1) as w from g join c using (sha)),
y as (select *, sum(w) over win as cw, sum(w) over (partition by priority) as tw, sum(y) over (partition by priority) as td, row_number() over win as rn from h window win as (partition by priority order by -churn, w, sha rows unbounded preceding))
select priority, count(*) as files, sum(w)::bigint as inspected, round(count(*) filter (y > 0)::double / count(*), 6) as precision, round(coalesce(sum(y)::double / nullif(max(td), 0), 0), 6) as recall_defects from y where cw <= 0.2 * tw or rn = 1 group by 1""",
    "jit_auc": _FEAT + """, ex as (select sha, priority, row_number() over (partition by author order by ct, sha) - 1 as exp from c), j as (select g.*, priority, exp from g join ex using (sha)),
l as (""" + " union all ".join(f"select '{c}' as feature, priority, round({c}::double, 9) as risk from j" for c in ("la", "ld", "nf", "nd", "ns", "entropy", "exp")) + "), "
    + _auc_sql("feature", source="l", risk="risk", positive="priority = '1-URGENT'"),
    "temporal_windows": "with " + _WIN + ", " + _auc_sql("t0", source="x", risk="round(value, 6)", positive="event_type = 'purchase'"),
    "temporal_summary": "with " + _WIN + ", " + _auc_sql("t0", source="x", risk="round(value, 6)", positive="event_type = 'purchase'").rsplit("\nselect", 1)[0] + ", q as (select" + _auc_sql("t0", source="x", risk="round(value, 6)").rsplit("\nselect", 1)[1]
    + ") select count(auc) as windows, min(auc) as least, max(auc) as most, round(max(auc) - min(auc), 6) as range, round(avg(auc), 6) as mean from q",
    "last_row_wins": "with " + _RUNS + " select task, arm, ord, cost, turns from rr",
    "paired_metrics": "with " + _RUNS + """, l as (select 'cost' as metric, a_cost as a, b_cost as b from pr union all select 'turns', a_turns, b_turns from pr),
x as (select metric, avg(a) as ma, avg(b) as mb, median(a) as da, median(b) as db from l group by 1), y as (select *, case when ma = 0 then 0.0 else 100 * (mb - ma) / ma end as p, case when da = 0 then 0.0 else 100 * (db - da) / da end as q from x)
select metric, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(da, 6) as median_a, round(db, 6) as median_b, round(p, 6) as delta_pct, round(q, 6) as median_delta_pct, case when (case metric when 'turns' then mb > ma else mb < ma end) then 'b' when abs(p) < 1 then 'tied' else 'a' end as tag,
  case when (case metric when 'turns' then db > da else db < da end) then 'b' when abs(q) < 1 then 'tied' else 'a' end as median_tag from y""",
    "win_counts": "with " + _RUNS + " select count(*) as tasks, count(*) filter (b_cost < a_cost) as cheaper, count(*) filter (b_turns < a_turns) as shorter, count(*) filter (b_turns >= a_turns) as no_worse from pr",
    "paired_totals": "with " + _RUNS + ", x as (select sum(a_cost) as a, sum(b_cost) as b from pr) select round(a, 6) as a, round(b, 6) as b, round(100 * (b - a) / a, 6) as delta_pct from x",
    "trimmed_mean": "with " + _RUNS + """, x as (select round(b_cost - a_cost, 9) as d, ord from pr), y as (select d, row_number() over (order by d, ord) as k, count(*) over () as n from x)
select 'cost' as metric, round(avg(d), 6) as trimmed, count(*) as kept from y where n <= 4 or (k > 2 and k <= n - 2)""",
    "best_worst": "with " + _RUNS + ", x as (select task, ord, round(a_cost - b_cost, 6) as s from pr) select (select task from x order by s desc, ord limit 1) as best, (select task from x order by s, ord desc limit 1) as worst",
    "delta_quantiles": "with " + _RUNS + ", x as (select b_cost - a_cost as d from pr) select " + ", ".join(f"round(quantile_cont(d, {q}), 6) as p{int(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from x",
    "turn_histogram": "with " + _RUNS + " select arm, turns, count(*) as n from rr group by 1, 2",
    "judge_score": """select o_orderkey as task, case o_orderkey % 4 when 3 then null when 2 then (o_custkey % 11)::double else (floor(o_totalprice / 1000) + o_custkey % 11)::double / 2 end as score from orders""",
    "resume_antijoin": "with " + _RUNS + ", a(arm) as (values ('click'), ('purchase'), ('view')) select t.task, a.arm from (select distinct task from rr) t, a where not exists (select 1 from rr where rr.task = t.task and rr.arm = a.arm and turns <= 50)",
    "budget_gate": """with b as (select user_id as task, coalesce(sum(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as spent from events)
select task, count(*) filter (spent + 1.0 <= 500) as allowed, round(max(spent) filter (spent + 1.0 <= 500), 6) as spent from b group by 1""",
    "cost_model": "select event_type, round(sum(case when event_id % 2 = 0 or value = 0 then (event_id * 3 + user_id * 15 + 1000 * 0.3::double) / 1e6 else value end), 6) as cost from events group by 1",
    "token_summary_rollup": "with " + _TOK + """, r as (select *, case when skipped is null then naive::double / nullif(context, 0) end as rn, case when skipped is null then diff::double / nullif(context, 0) end as rd from t)
select repo, count(*) filter (skipped is null) as commits, count(*) filter (skipped is not null) as skipped, """
    + ", ".join(f"(sum({c}) filter (skipped is null))::bigint as sum_{c}, (sum({c}) filter (skipped is null) // count(*) filter (skipped is null))::bigint as mean_{c}" for c in ("naive", "diff", "context"))
    + """, round((sum(naive) filter (skipped is null))::double / sum(context) filter (skipped is null), 6) as pooled_naive, round((sum(diff) filter (skipped is null))::double / sum(context) filter (skipped is null), 6) as pooled_diff,
  round(avg(rn), 6) as mean_ratio_naive, round(avg(rd) filter (rd > 0), 6) as mean_ratio_diff, round(median(rn), 6) as median_ratio, round(max(rn), 6) as max_ratio from r group by rollup (repo)""",
    "skip_reasons": "with " + _TOK + " select skipped, count(*) as n from t where skipped is not null group by 1",
    "repo_histogram": "select source as repo, count(*) as n from documents group by 1",
    "stream_summary": """with e as (select user_id as run, event_id as o, event_type as t, value, 'f' || (event_id % 5) || '.py' as p, event_id % 3 as k from events where event_type <> 'view'),
l as (select run, arg_max(value, o) as cost, arg_max((o % 9)::int, o) as turns, max(o) as tokens_in from e where t = 'purchase' group by 1)
select run, count(*) filter (t <> 'purchase') as tool_calls, count(*) filter (t <> 'purchase' and k = 2) as helpers, coalesce(string_agg(distinct p, ',' order by p) filter (t <> 'purchase' and k = 0), '') as files_read,
  coalesce(string_agg(distinct p, ',' order by p) filter (t <> 'purchase' and k = 1), '') as files_edited, round(max(cost), 6) as cost, max(turns) as turns, max(tokens_in) as tokens_in, case when max(tokens_in) is not null then 2 end as tokens_out
from e left join l using (run) group by 1""",
    "failure_reasons": """with e as (select user_id as run, event_id as o, event_id % 1009 as k, event_id % 97 = 7 and event_id % 1009 not in (3, 5) as again from events),
f as (select run, min(o) filter (k in (3, 5)) as f, max((o % 3) * 1000000000 + o) filter (again) % 1000000000 as r from e group by 1)
select run, case when f is not null then case f % 1009 when 3 then 'stop ' else 'failed ' end || f when r is not null then 'again ' || r when run % 3 = 0 then 'killed ' || run else 'unknown failure' end as reason from f""",
    "fifo_pairs": """with e as (select user_id as run, event_id as ord, event_type = 'click' as call from events where event_type in ('click', 'purchase')),
l as (select *, sum(case when call then 1 else -1 end) over w as level, count(*) filter (call) over w as calls, count(*) filter (not call) over w as results from e window w as (partition by run order by ord rows unbounded preceding)),
m as (select *, greatest(0, -min(level) over (partition by run order by ord rows unbounded preceding)) as idle from l),
n as (select *, coalesce(lag(idle) over (partition by run order by ord), 0) as was from m),
r as (select run, ord as result_ord, results - idle as k from n where not call and idle = was)
select n.run, n.ord as call_ord, r.result_ord from n left join r on r.run = n.run and r.k = n.calls where n.call""",
    "resume_set": "select distinct user_id::varchar as task_id, event_type as condition from events where event_id % 5 >= 3",
    "task_selection": """with a as (select n_nationkey, n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as k from nation),
b as (select n_nationkey, k as at, n_regionkey from a where n_regionkey in (0, 1, 2) and (k in (0, 2) or k not in (1, 3, 2)) order by n_regionkey, k offset 2 limit 5) select n_nationkey, "at" from b""".replace("k as at", 'k as "at"'),
    "pr_signals": """with x as (select *, epoch(l_shipdate) as t, min(epoch(l_shipdate)) filter (l_returnflag <> 'N') over (partition by l_orderkey) as fr from lineitem)
select l_orderkey, round((max(t) - min(t)) / 3600, 4) as commit_span_h, count(*) as n_commits, count(*) filter (l_returnflag <> 'N') as review_rounds, count(*) filter (l_returnflag = 'R') as changes_requested,
  count(*) filter (t > fr) as commits_after_first_review, round(count(*) filter (l_returnflag <> 'N')::double / sum(l_quantity), 6) as review_density, sum(l_quantity)::bigint as changed_lines, count(distinct l_partkey) as changed_files from x group by 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        commit_features, change_entropy, numstat_lines, author_experience, right_censor, time_split, jit_effort, jit_auc, temporal_windows, temporal_summary, last_row_wins, paired_metrics, win_counts, paired_totals,
        trimmed_mean, best_worst, delta_quantiles, turn_histogram, judge_score, resume_antijoin, budget_gate, cost_model, token_summary_rollup, token_summary_bpe, skip_reasons, repo_histogram, stream_summary, failure_reasons, fifo_pairs,
        resume_set, task_selection, pr_signals,
    )
}
