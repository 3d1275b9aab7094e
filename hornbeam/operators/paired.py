"""Paired comparison of two arms, budget and token summaries, and summaries of agent event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.operators import ranking as R


def last_row_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row that comes last; rows with a null key are dropped."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def judge_score(scores: Column) -> Column:
    """Mean of a map's numbers; null when it has none."""
    values = F.filter(F.map_values(scores), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def cost_model(cost: Column, tokens_in: Column, tokens_out: Column, cached: Column) -> Column:
    """The told cost, or one from tokens where it is 0."""
    return F.when(F.coalesce(cost, F.lit(0.0)) == 0, (tokens_in * 3 + tokens_out * 15 + cached * 0.3) / 1e6).otherwise(cost)


def pairs(runs: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """``task, ord, a_x, b_x...`` of tasks that have both arms, with no value null in either."""
    pick = lambda arm, v: F.max(F.when(F.col("arm") == arm, F.col(v))).alias(f"{'a' if arm == a else 'b'}_{v}")
    wide = runs.where(F.col("arm").isin(a, b)).groupBy("task").agg(*(pick(x, v) for v in values for x in (a, b)), F.min("ord").alias("ord"))
    return wide.dropna(subset=[f"{x}_{v}" for v in values for x in "ab"])


def metric_block(paired: DataFrame, values: list[str], higher_better: tuple[str, ...] = ()) -> DataFrame:
    """``metric, mean_a, mean_b, median_a, median_b, delta_pct, median_delta_pct, tag, median_tag``; a base of 0 makes a
    delta of 0.

    A tag says which arm is better by the mean or the median: b where it is lower (higher for metrics named in
    ``higher_better``), else tied below 1 %, else a.
    """
    row = lambda v: F.struct(F.lit(v).alias("metric"), F.lit(v in higher_better).alias("up"), F.col(f"a_{v}").cast("double").alias("a"), F.col(f"b_{v}").cast("double").alias("b"))
    long = paired.select(F.explode(F.array(*map(row, values))).alias("m")).select("m.*")
    out = long.groupBy("metric", "up").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.median("a").alias("median_a"), F.median("b").alias("median_b"))
    pct = lambda x, y: F.coalesce(100 * F.try_divide(F.col(y) - F.col(x), F.nullif(F.col(x), F.lit(0.0))), F.lit(0.0))
    out = out.withColumn("delta_pct", pct("mean_a", "mean_b")).withColumn("median_delta_pct", pct("median_a", "median_b"))
    better = lambda x, y: F.when(F.col("up"), F.col(y) > F.col(x)).otherwise(F.col(y) < F.col(x))
    tag = lambda x, y, p: F.when(better(x, y), "b").when(F.abs(p) < 1, "tied").otherwise("a")
    return out.withColumn("tag", tag("mean_a", "mean_b", "delta_pct")).withColumn("median_tag", tag("median_a", "median_b", "median_delta_pct")).drop("up")


def trimmed_mean(df: DataFrame, by: list[str], value: str, order: str, k: int = 2) -> DataFrame:
    """``by..., trimmed``: the mean without the k least and greatest; of everything with four values or fewer."""
    w = Window.partitionBy(*by)
    d = df.withColumn("__up", F.row_number().over(w.orderBy(value, order))).withColumn("__n", F.count("*").over(w))
    kept = d.where((F.col("__n") <= 4) | ((F.col("__up") > k) & (F.col("__up") <= F.col("__n") - k)))
    return kept.groupBy(*by).agg(F.avg(value).alias("trimmed"), F.count("*").alias("kept"))


def token_summary(rows: DataFrame) -> DataFrame:
    """Overall (null repo) and by repo: totals, whole means, pooled and mean ratios, median, max, skipped.

    ``rows(repo, naive, diff, context, skipped)``; ratios are over the context, null where it is 0.  The mean of diff
    ratios leaves out those that are not positive.
    """
    ok = F.col("skipped").isNull()
    val = lambda c: F.when(ok, F.col(c))
    r = rows.withColumn("rn", F.when(ok, F.try_divide("naive", "context"))).withColumn("rd", F.when(ok, F.try_divide("diff", "context")))
    n = F.count_if(ok)
    return r.rollup("repo").agg(
        n.alias("commits"), F.count_if(~ok).alias("skipped"),
        *(F.sum(val(c)).alias(f"sum_{c}") for c in ("naive", "diff", "context")),
        *(F.floor(F.try_divide(F.sum(val(c)), n)).cast("long").alias(f"mean_{c}") for c in ("naive", "diff", "context")),
        F.try_divide(F.sum(val("naive")), F.sum(val("context"))).alias("pooled_naive"), F.try_divide(F.sum(val("diff")), F.sum(val("context"))).alias("pooled_diff"),
        F.avg("rn").alias("mean_ratio_naive"), F.avg(F.when(F.col("rd") > 0, F.col("rd"))).alias("mean_ratio_diff"), F.median("rn").alias("median_ratio"), F.max("rn").alias("max_ratio"),
    )


def budget(runs: DataFrame, limit: float, estimate: float, by: list[str]) -> DataFrame:
    """Adds ``spent`` before each run, and ``allowed``: whether that and an estimate stay within the limit.  A null cost is 0; a
    task with very many runs is many ranges, not a task of Spark's.  A run's own cost is never added: taken off again, it
    would leave a rounding error that decides at the limit."""
    d = R.running(runs.withColumn("__cost", F.coalesce(F.col("cost").cast("double"), F.lit(0.0))), by, [F.col("ord")], {"spent": "__cost"}, own=False)
    return d.drop("__cost").withColumn("allowed", F.col("spent") + estimate <= limit)


#: What is read of an event; unknown fields are ignored.
EVENT = (
    "type string, subtype string, total_cost_usd double, num_turns int, is_error boolean, result string, attempt int, error string, "
    "message struct<content:array<struct<type:string,name:string,id:string,is_error:boolean,input:struct<file_path:string>>>>, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint>"
)
# Tools that touch files, and the one that starts a helper.
READERS, EDITORS, HELPER = ("Read",), ("Write", "Edit", "MultiEdit"), "Task"


def parse_events(lines: DataFrame) -> DataFrame:
    """``run, ord, e`` of lines that hold a JSON object; blank and broken lines are dropped."""
    e = F.from_json("line", EVENT, {"mode": "PERMISSIVE"})
    return lines.withColumn("e", e).where(F.trim("line").startswith("{") & F.col("e.type").isNotNull()).select("run", "ord", "e")


def stream_summary(lines: DataFrame) -> DataFrame:
    """For each run: tool calls, files read and edited (distinct, sorted), helpers, and the last result's figures."""
    e = parse_events(lines)
    uses = F.filter(F.coalesce(F.col("e.message.content"), F.array().cast("array<struct<type:string,name:string,id:string,is_error:boolean,input:struct<file_path:string>>>")), lambda c: c["type"] == "tool_use")
    e = e.withColumn("uses", uses)
    paths = lambda names: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter("uses", lambda c: c["name"].isin(*names) & c["input"]["file_path"].isNotNull()), lambda c: c["input"]["file_path"])))))
    last = F.max_by(F.struct("e.total_cost_usd", "e.num_turns", "e.usage.input_tokens", "e.usage.output_tokens", "e.is_error"), F.when(F.col("e.type") == "result", F.col("ord")))
    out = e.groupBy("run").agg(
        F.sum(F.size("uses")).alias("tool_calls"), F.sum(F.size(F.filter("uses", lambda c: c["name"] == HELPER))).alias("helpers"),
        F.array_join(paths(READERS), ",").alias("files_read"), F.array_join(paths(EDITORS), ",").alias("files_edited"), last.alias("r"),
    )
    return out.select("run", "tool_calls", "helpers", "files_read", "files_edited", F.col("r.total_cost_usd").alias("cost"), F.col("r.num_turns").alias("turns"), F.col("r.input_tokens").alias("tokens_in"), F.col("r.output_tokens").alias("tokens_out"))


def failure_reason(lines: DataFrame, stderr: DataFrame, fallback: str = "unknown failure") -> DataFrame:
    """For each run the first error told; else the retry with the greatest attempt, the later of equals; else what it wrote
    to stderr; else the fallback."""
    e = parse_events(lines)
    bad = (F.col("e.type") == "system") & (F.col("e.subtype") == "error") | (F.col("e.type") == "result") & F.coalesce(F.col("e.is_error"), F.lit(False))
    first = F.min_by(F.coalesce("e.error", "e.result"), F.when(bad, F.col("ord")))
    retry = F.max_by("e.error", F.when(F.col("e.subtype") == "retry", F.struct("e.attempt", "ord")))
    told = e.groupBy("run").agg(first.alias("first"), retry.alias("retry"))
    return stderr.join(told, "run", "left").select("run", F.coalesce("first", "retry", F.nullif(F.substring("stderr", 1, 500), F.lit("")), F.lit(fallback)).alias("reason"))


def fifo_pairs(events: DataFrame) -> DataFrame:
    """``run, call_ord, result_ord``: every result takes the oldest call that is still open; without one it takes none.

    The k-th result that finds a call takes the k-th call.  How many results have found one follows from running sums: the
    queue is empty as often as the running surplus of results reaches a new height.  A long run is many ranges, not a task.
    """
    e = events.withColumn("step", F.when(F.col("kind") == "call", 1).otherwise(-1).cast("long"))
    e = e.withColumns({"is_result": (F.col("kind") == "result").cast("long"), "is_call": (F.col("kind") == "call").cast("long")})
    e = R.running(e, ["run"], [F.col("ord")], {"results": "is_result", "calls": "is_call"})
    e = R.running_low(e, ["run"], [F.col("ord")], "step", "level", "low", "low_before")
    idle = lambda x: F.greatest(F.lit(0), -F.coalesce(x, F.lit(0)))
    e = e.withColumn("idle", idle(F.col("low"))).withColumn("idle_before", idle(F.col("low_before")))
    served = e.where((F.col("kind") == "result") & (F.col("idle") == F.col("idle_before"))).select("run", F.col("ord").alias("result_ord"), (F.col("results") - F.col("idle")).alias("k"))
    calls = e.where("kind = 'call'").select("run", F.col("ord").alias("call_ord"), F.col("calls").alias("k"))
    return calls.join(served, ["run", "k"], "left").select("run", "call_ord", "result_ord")
