"""Registered queries that write through the sinks and caches and read back, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.plans.rank_queries import _rounded
from hornbeam.plans.stream_queries import _events
from hornbeam.sources import readers as S
from hornbeam.sources.cache import BATCH, DIGEST, KeyedCache, digest
from hornbeam.sources.store import folder
from hornbeam.sources.tables import read
from hornbeam.streaming import streams

PARTS = 6


class _Interrupted(Exception):
    pass


def cached_scores(spark, d):
    """A value for each order from its lines, kept by key: a first run over older inputs is interrupted after two of six
    parts, the second run computes what is missing or was made from another input, and ``reused`` tells what it did not."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    older = orders.withColumn("status", F.when(F.col("key") % 10 == 0, "?").otherwise(F.col("status")))
    line = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    keyed = lambda t: t.select("key", digest("price", "status").alias(DIGEST))
    cache = KeyedCache(spark, folder(spark, "scores"), ["key"])
    done = []

    def first(part):
        if len(done) == 2:
            raise _Interrupted
        done.append(1)
        return part.join(line, "key", "left")

    try:
        cache.fill(keyed(older), first, PARTS, 1)
    except _Interrupted:
        pass
    out = cache.fill(keyed(orders), lambda part: part.join(line, "key", "left"), PARTS, 2)
    return _rounded(out.select("key", F.coalesce("value", F.lit(0.0)).alias("value"), F.col(BATCH).startswith("000001").alias("reused")), "value")


def stream_cache(spark, d):
    """Counts and sums by user and type of a stream, each micro-batch kept under its number; every one comes twice."""
    cache = KeyedCache(spark, folder(spark, "sums"), ["user_id", "event_type"])
    keep = cache.sink(1)

    def twice(rows, i):
        sums = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn(DIGEST, F.lit("-"))
        keep(sums, i)
        keep(sums, i)

    streams.each_batch(_events(spark, d).select("user_id", "event_type", "value"), twice, folder(spark, "sums-log"))
    return _rounded(cache.rows().groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "total")


def stream_progress(spark, d):
    """What a listener keeps of a stream: the rows of all its batches, and that it ended well."""
    told = streams.Progress()
    spark.streams.addListener(told)
    try:
        query = streams.appended(_events(spark, d).select("event_id"), folder(spark, "progress"))
        seen = told.wait(query.runId)
    finally:
        spark.streams.removeListener(told)
    counted = read(spark, d, "events").agg(F.count("*").alias("rows"))  # the listener's number beside the table's
    return counted.select(F.lit(seen["rows"]).cast("long").alias("seen"), "rows", F.lit(seen["ended"]).alias("ended"), F.lit(seen["error"]).cast("string").alias("error"))


def sink_round_trips(spark, d):
    """Customers through every sink and back: JSON report, two appends, CSV with header, folders by key."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    schema, parts = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", {}
    path = {k: folder(spark, k) for k in ("report", "appended", "table", "keyed")}
    S.write_report(c, path["report"])
    parts["report"] = spark.read.schema(schema).json(path["report"])
    S.append_results(c.where("c_custkey % 2 = 0"), path["appended"])
    S.append_results(c.where("c_custkey % 2 = 1"), path["appended"])
    parts["appended"] = spark.read.schema(schema).json(path["appended"])
    S.write_csv(c, path["table"])
    parts["table"] = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path["table"])
    S.write_by_key(c, path["keyed"], ["c_mktsegment"])
    parts["keyed"] = spark.read.schema(schema).option("basePath", path["keyed"]).json(path["keyed"])
    out = None
    for sink, rows in parts.items():
        one = rows.groupBy(F.lit(sink).alias("sink"), "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("c_name").alias("names"), F.sum("c_acctbal").alias("balance"))
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "balance")


_PART = f"(('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % {PARTS})"
SQL = {
    "cached_scores": f"""with p as (select row_number() over (order by p) as i, p from (select distinct {_PART} as p from orders)),
l as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as v from lineitem group by 1)
select o_orderkey as key, round(coalesce(v, 0), 6) as value, i <= 2 and o_orderkey % 10 <> 0 as reused from orders join p on p.p = {_PART} left join l on l_orderkey = o_orderkey""",
    "stream_cache": "select user_id, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "stream_progress": "select count(*) as seen, count(*) as rows, true as ended, null::varchar as error from events",
    "sink_round_trips": "select sink, c_mktsegment, count(*) as n, count(distinct c_name) as names, round(sum(c_acctbal), 6) as balance from customer, (values ('report'), ('appended'), ('table'), ('keyed')) s(sink) group by 1, 2",
}
QUERIES = {f.__name__: f for f in (cached_scores, stream_cache, stream_progress, sink_round_trips)}
