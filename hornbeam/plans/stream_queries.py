"""Registered streaming queries: each drains its stream, so that its result can be compared with a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.operators import paired as P
from hornbeam.plans.change_queries import SQL as CHANGES
from hornbeam.plans.change_queries import agent_lines
from hornbeam.plans.rank_queries import _rounded
from hornbeam.streaming import streams as S


def _events(spark, d):
    """The events table as a stream; a folder is made of the one file by reading its parent with a filter on the name."""
    path = f"{d.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d.rstrip("/")).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(spark, d):
    e = _events(spark, d).select("ts", F.col("user_id").alias("task"), F.col("event_type").alias("arm"))
    out = S.once_by_key(e, ["task", "arm"], "ts", "60 days")
    return S.drained(spark, out.select("task", "arm"), "append", "dedup")


def stream_tumbling(spark, d):
    out = S.windowed(_events(spark, d), "ts", "1 day", by=("event_type",)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))
    return _rounded(S.drained(spark, out, "complete", "tumbling"), "total")


def stream_sliding(spark, d):
    out = S.windowed(_events(spark, d), "ts", "14 days", "7 days").withColumn("start", F.date_format("start", "yyyy-MM-dd"))
    return _rounded(S.drained(spark, out, "complete", "sliding"), "total")


def stream_sessions(spark, d):
    out = S.sessions(_events(spark, d), "ts", "12 hours", "user_id").select("user_id", F.unix_seconds("start").alias("start"), "n")
    return S.drained(spark, out, "complete", "sessions")


def stream_budget(spark, d):
    e = _events(spark, d).select("user_id", F.col("event_id").alias("ord"), F.col("value").alias("cost"))
    t = S.drained(spark, S.budget_gate(e, "user_id", 500.0, 1.0), "append", "budget")
    return t.groupBy(F.col("user_id").alias("task")).agg(F.count_if("allowed").alias("allowed"), F.round(F.max(F.when(F.col("allowed"), F.col("spent"))), 4).alias("spent"))


def stream_runs(spark, d):
    """Run summaries kept up to date over a stream of agent events."""
    out = P.stream_summary(agent_lines(_events(spark, d)))
    return _rounded(S.drained(spark, out, "complete", "runs"), "cost")


SQL = {
    "stream_runs": CHANGES["stream_summary"],
    "stream_dedup": "select distinct user_id as task, event_type as arm from events",
    "stream_tumbling": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "stream_sliding": """with w as (select unnest(generate_series(timestamp '2023-11-30', timestamp '2024-03-07', interval 7 days)) as s)
select strftime(s, '%Y-%m-%d') as start, count(*) as n, round(sum(value), 6) as total from events, w where ts >= s and ts < s + interval 14 days group by 1""",
    "stream_sessions": """with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 12 hours then 0 else 1 end as b from events),
i as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from i group by user_id, k""",
    "stream_budget": """with b as (select user_id as task, coalesce(sum(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as spent from events)
select task, count(*) filter (spent + 1.0 <= 500) as allowed, round(max(spent) filter (spent + 1.0 <= 500), 4) as spent from b group by 1""",
}

QUERIES = {f.__name__: f for f in (stream_dedup, stream_tumbling, stream_sliding, stream_sessions, stream_budget, stream_runs)}
