"""The provided tables in the engine's terms: scored units, findings, commits, runs and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit_id, cluster, stratum, ord, score, rival, size, defects, strict``: parts with the outcomes of their lines.

    ``score`` is low for risky units, ``rival`` is a second scorer, ``strict`` a second label.  Lines are summed before
    the join, so the join meets one row a part.
    """
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    hit = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.085)
    sums = line.groupBy(F.col("l_partkey").alias("unit_id")).agg(
        F.sum("l_quantity").cast("long").alias("size"),
        F.count_if(hit).alias("defects"),
        F.count_if(hit & (F.col("l_linestatus") == "F")).alias("strict"),
    )
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("unit_id"),
        F.col("p_brand").alias("cluster"),
        F.col("p_type").alias("stratum"),
        F.col("p_partkey").alias("ord"),
        (F.col("p_size") / F.lit(5.0)).alias("score"),
        ((F.col("p_retailprice") - 900) / F.lit(10.0)).alias("rival"),
    )
    return part.join(sums, "unit_id", "left").fillna(0, ["size", "defects", "strict"])


UNITS_SQL = """u as (select p_partkey as unit_id, p_brand as cluster, p_type as stratum, p_partkey as ord, p_size / 5.0::double as score,
  (p_retailprice - 900) / 10.0::double as rival, coalesce(size, 0)::bigint as size, coalesce(defects, 0)::bigint as defects,
  coalesce(strict, 0)::bigint as strict
  from part left join (select l_partkey, sum(l_quantity)::bigint as size,
    count(*) filter (l_returnflag = 'R' and l_discount >= 0.085) as defects,
    count(*) filter (l_returnflag = 'R' and l_discount >= 0.085 and l_linestatus = 'F') as strict
    from lineitem group by 1) on l_partkey = p_partkey)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit_id, ord, biomarker, severity, impact, magnitude``: one finding for each line of an order."""
    line = read(spark, sf_dir, "lineitem")
    severity = (
        F.when(F.col("l_quantity") < 13, "low").when(F.col("l_quantity") < 26, "medium").when(F.col("l_quantity") < 39, "high").otherwise("critical")
    )
    return line.select(
        F.col("l_partkey").alias("unit_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.concat("l_returnflag", "l_linestatus").alias("biomarker"),
        severity.alias("severity"),
        F.col("l_discount").alias("impact"),
        F.col("l_tax").alias("magnitude"),
    )


FINDINGS_SQL = """f as (select l_partkey as unit_id, l_orderkey * 8 + l_linenumber as ord, l_returnflag || l_linestatus as biomarker,
  case when l_quantity < 13 then 'low' when l_quantity < 26 then 'medium' when l_quantity < 39 then 'high' else 'critical' end as severity,
  l_discount as impact, l_tax as magnitude from lineitem)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sha, author, ct, priority``: an order is a commit; ``ct`` in epoch seconds."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.unix_timestamp("o_orderdate").alias("ct"), F.col("o_orderpriority").alias("priority")
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sha, path, la, ld``: the lines of an order are the files a commit touches."""
    line = read(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("src/"), F.pmod("l_suppkey", F.lit(7)).cast("string"), F.lit("/d"), F.pmod("l_suppkey", F.lit(13)).cast("string"), F.lit("/f"), F.pmod("l_partkey", F.lit(97)).cast("string"), F.lit(".py"))
    return line.select(F.col("l_orderkey").alias("sha"), path.alias("path"), F.col("l_quantity").cast("long").alias("la"), F.col("l_linenumber").cast("long").alias("ld"))


COMMITS_SQL = """c as (select o_orderkey as sha, o_custkey as author, epoch(o_orderdate)::bigint as ct, o_orderpriority as priority from orders)"""
FILES_SQL = """cf as (select l_orderkey as sha, 'src/' || (l_suppkey % 7) || '/d' || (l_suppkey % 13) || '/f' || (l_partkey % 97) || '.py' as path,
  l_quantity::bigint as la, l_linenumber::bigint as ld from lineitem)"""
