"""Registered queries that read what they read through the readers: whole tables are written out in the documents' own
formats, one folder a cluster, and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from hornbeam.plans.rank_queries import _rounded
from hornbeam.sources import history as H
from hornbeam.sources import readers as S
from hornbeam.sources.store import folder
from hornbeam.sources.tables import COMMITS_SQL, FINDINGS_SQL, UNITS_SQL, commits, findings, read, units

#: The folder of a cluster's documents.
MARKER = "/cluster="


#: A document holds what falls in one run of so many ids: documents, and what a task builds and parses at once, stay of one
#: size, and a larger input gives more of them.
RUN = 5000


def _run(key):
    return F.floor(F.col(key) / RUN).alias("run")


def _put(spark, rows, by: str | None = "cluster", sep: str = "\n") -> str:
    """Text rows in files, each ended by ``sep``; with ``by`` a folder for each value."""
    path = folder(spark, "documents")
    (rows.write.partitionBy(by) if by else rows.write).option("lineSep", sep).text(path)
    return path


def _units(spark, d):
    """Units with a cluster name that is a plain folder name, and a path of their own."""
    number = F.substring_index("cluster", "#", -1)
    return units(spark, d).withColumn("cluster", F.concat(F.lit("c"), number)).withColumn("file_path", F.concat(F.lit("src/u"), F.col("unit_id").cast("string"), F.lit(".py")))


_C = "uc as (select * replace ('c' || regexp_extract(cluster, '[0-9]+$') as cluster), 'src/u' || unit_id || '.py' as file_path from u)"


def _object(key, value):
    """One JSON object for each group, of keys and values."""
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value))), {"ignoreNullFields": "false"}).alias("value")


def read_documents(spark, d):
    """Health documents in noisy output: files scored and their mean, and findings, of each cluster."""
    u = _units(spark, d)
    f = findings(spark, d).join(u.select("unit_id", "cluster", "file_path"), "unit_id")
    metrics = u.groupBy("cluster", _run("unit_id")).agg(F.collect_list(F.struct("file_path", F.col("score").alias("health_score"), F.col("size").cast("int").alias("nloc"))).alias("metrics"))
    told = f.groupBy("cluster", _run("unit_id")).agg(F.collect_list(F.struct("file_path", F.col("biomarker").alias("biomarker_type"), "severity", F.col("impact").alias("health_impact"))).alias("findings"))
    document = F.concat(F.lit("warming up {not it}\n"), F.to_json(F.struct(F.create_map(F.lit("a"), F.lit("1")).alias("kpis"), "metrics", F.coalesce("findings", F.array()).alias("findings"))))
    path = _put(spark, metrics.join(told, ["cluster", "run"], "left").select("cluster", document.alias("value")), sep=S.RECORD)
    docs = S.health_documents(spark, path, MARKER, S.RECORD)
    files = S.scored_files(docs).groupBy("cluster").agg(F.count("*").alias("files"), F.avg("health_score").alias("mean_score"), F.sum("nloc").alias("nloc"))
    found = S.findings(docs).groupBy("cluster").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.sum("health_impact").alias("impact"))
    return _rounded(files.join(found, "cluster"), "mean_score", "impact")


def read_labels(spark, d):
    """Label maps joined to files by path: an absent label is 0."""
    u = _units(spark, d)
    labels = u.where("defects > 0").groupBy("cluster", _run("unit_id")).agg(_object(F.concat(F.lit("/"), F.replace("file_path", F.lit("/"), F.lit("\\"))), F.col("defects")))
    path = _put(spark, labels.drop("run"), sep=S.RECORD)
    joined = S.with_labels(u.select("cluster", "file_path"), S.label_map(spark, path, MARKER, S.RECORD))
    return joined.groupBy("cluster").agg(F.count("*").alias("files"), F.sum("defect_count").alias("defects"), F.count_if(F.col("defect_count") > 0).alias("defective"))


def read_second_scores(spark, d):
    """Another scorer's cache with nulls and gaps, paired with the files."""
    u = _units(spark, d)
    told = u.where("unit_id % 10 <> 0").groupBy("cluster", _run("unit_id")).agg(_object(F.col("file_path"), F.when(F.col("unit_id") % 7 != 0, F.col("rival"))))
    path = _put(spark, told.drop("run"), sep=S.RECORD)
    return S.pairing(u.select("cluster", "file_path"), S.second_scores(spark, path, MARKER, S.RECORD), ["cluster", "file_path"]).groupBy("state").agg(F.count("*").alias("n"))


def read_coverage(spark, d):
    """Coverage artifacts: what is configured for a cluster goes before what is cached, and a file without a number is null."""
    u = _units(spark, d)
    artifact = lambda rows, pct: _put(
        spark, rows.groupBy("cluster", _run("unit_id")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("file_path"), F.struct(pct.alias("line_coverage_pct"))))).alias("files"))).alias("value")).drop("run")
    )
    number = F.regexp_extract("cluster", "[0-9]+", 0).cast("int")
    first = S.coverage(spark, artifact(u.where(number % 2 == 0), F.when(F.col("unit_id") % 3 != 0, F.col("score") * 10)), MARKER, lines=True)
    second = S.coverage(spark, artifact(u.where(number % 3 != 0), F.lit(50.0)), MARKER, lines=True)
    out = H.located(first, second).groupBy("cluster").agg(F.count("*").alias("files"), F.count("line_coverage_pct").alias("measured"), F.avg("line_coverage_pct").alias("mean_pct"))
    return _rounded(out, "mean_pct")


def read_report_auc(spark, d):
    """One number out of each cluster's report."""
    value = F.to_json(F.struct(F.struct(F.struct((F.count_if(F.col("defects") > 0) / F.count("*")).alias("auc")).alias("strict")).alias("label_comparison")))
    path = _put(spark, _units(spark, d).groupBy("cluster").agg(value.alias("value")))
    return _rounded(S.nested_auc(spark, path, "strict", MARKER), "auc")


def read_issues(spark, d):
    """Cached issues of all orders, many a folder; a cached 404 has no state."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("number"), F.col("o_orderpriority").alias("priority"))
    found = F.struct("number", F.lit("closed").alias("state"), F.array("priority").alias("labels"), (F.col("number") % 3 == 0).alias("is_pr"))
    body = F.when(F.col("number") % 5 == 0, F.to_json(F.struct("number", F.lit(True).alias("_missing")))).otherwise(F.to_json(found))
    root = folder(spark, "issues") + "/cluster=c1"
    o.select(body.alias("value"), F.pmod("number", F.lit(8)).alias("n")).write.partitionBy("n").text(root)
    got = S.cached_issues(spark, root, MARKER, lines=True)
    return got.select("cluster", "number", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("is_pr", F.lit(False)).alias("is_pr"), F.col("_missing").alias("missing"))


def read_commit_log(spark, d):
    """A log of all commits as text, a NUL between sha and subject."""
    subject = F.concat(F.col("priority"), F.lit(" by "), F.col("author").cast("string"))
    path = _put(spark, commits(spark, d).select(F.concat(F.when(F.col("sha") % 50 != 0, F.col("sha").cast("string")).otherwise(""), F.lit("\u0000"), subject).alias("value")), None)
    return H.commit_log(spark, path)


def read_file_lines(spark, d):
    """The lines of all documents as files, numbered from 1."""
    lines = H.file_lines(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    return lines.groupBy("doc_id").agg(F.max("lineno").cast("long").alias("lines"), F.sum(F.length("line").cast("long") * F.col("lineno")).alias("weighted"))


def read_json_lines(spark, d):
    """A log of JSON lines, broken ones and ones without a key among them."""
    k = F.col("event_id")
    line = F.when(k % 7 == 0, "{oops").when(k % 7 == 1, '{"value":1}').otherwise(F.format_string('{"user":"%s","value":%s}', F.col("user_id").cast("string"), F.col("value").cast("string")))
    rows = S.json_lines(spark, _put(spark, read(spark, d, "events").select(line.alias("value")), None), "user string, value double", ["user"])
    return _rounded(rows.groupBy("user").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


def read_class_metrics(spark, d):
    """A CSV of class metrics with a header; what is no number is null."""
    p = read(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("wmc"), F.col("p_retailprice").cast("string").alias("loc"))
    path = folder(spark, "classes")
    p.write.option("header", True).csv(path)
    return _rounded(S.ck_rows(spark, path, ["wmc", "loc"]).groupBy("name").agg(F.count("*").alias("n"), F.count("wmc").alias("measured"), F.sum("wmc").alias("wmc"), F.sum("loc").alias("loc")), "wmc", "loc")


def read_questions(spark, d):
    """Task rows in JSON arrays, a folder for each repository."""
    q = read(spark, d, "documents").where("source is not null").select("source", _run("doc_id"), F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repo"), F.lit("dev").alias("split_name"), F.col("lang").alias("question")).alias("q"))
    path = _put(spark, q.groupBy("source", "run").agg(F.to_json(F.collect_list("q")).alias("value")).drop("run"), "source")
    return S.questions(spark, path, lines=True).groupBy("repo").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("answer") == "").alias("unanswered"))


def read_configuration(spark, d):
    """The nations as a configuration's list, and the one of a name."""
    rows = read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = json.dumps({"repos": [{"name": r["n_name"], "key": str(r["n_nationkey"]), "extensions": [".py"]} for r in rows]})
    path = _put(spark, spark.createDataFrame([(text,)], "value string"), None)
    every = H.configured(spark, path)
    return every.join(H.configured(spark, path, name=rows[3]["n_name"]).select(F.col("name").alias("one")), F.col("name") == F.col("one"), "left").select("name", "key", "extensions", F.col("one").isNotNull().alias("asked"))


_WC = f"with {UNITS_SQL}, {_C}"
SQL = {
    "read_documents": f"{_WC}, {FINDINGS_SQL}, a as (select cluster, count(*) as files, avg(score) as m, sum(size)::bigint as nloc from uc group by 1), "
    + """b as (select cluster, count(*) as findings, count(*) filter (severity = 'critical') as critical, sum(impact) as impact from f join uc using (unit_id) group by 1)
select cluster, files, round(m, 6) as mean_score, nloc, findings, critical, round(impact, 6) as impact from a join b using (cluster)""",
    "read_labels": f"{_WC} select cluster, count(*) as files, sum(defects)::bigint as defects, count(*) filter (defects > 0) as defective from uc group by 1",
    "read_second_scores": "select case when p_partkey % 10 = 0 then 'absent' when p_partkey % 7 = 0 then 'null' else 'paired' end as state, count(*) as n from part group by 1",
    "read_coverage": f"""{_WC}, n as (select *, regexp_extract(cluster, '[0-9]+')::int as k from uc), c as (select cluster, case when k % 2 = 0 then case when unit_id % 3 <> 0 then score * 10 end else 50.0::double end as pct from n where k % 2 = 0 or k % 3 <> 0)
select cluster, count(*) as files, count(pct) as measured, round(avg(pct), 6) as mean_pct from c group by 1""",
    "read_report_auc": f"{_WC} select cluster, round(count(*) filter (defects > 0)::double / count(*), 6) as auc from uc group by 1",
    "read_issues": "select 'c1' as cluster, o_orderkey::int as number, case when o_orderkey % 5 = 0 then '' else 'closed' end as state, o_orderkey % 5 <> 0 and o_orderkey % 3 = 0 as is_pr, o_orderkey % 5 = 0 as missing from orders",
    "read_commit_log": f"with {COMMITS_SQL} select sha::varchar as sha, priority || ' by ' || author as subject from c where sha % 50 <> 0",
    "read_file_lines": """with t as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), e as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as k from t)
select doc_id, max(k) as lines, sum(length(line) * k)::bigint as weighted from e group by 1""",
    "read_json_lines": "select user_id::varchar as user, count(*) as n, round(sum(value), 6) as total from events where event_id % 7 > 1 group by 1",
    "read_class_metrics": "select p_name as name, count(*) as n, count(*) filter (p_partkey % 9 <> 0) as measured, round(sum(p_size) filter (p_partkey % 9 <> 0), 6)::double as wmc, round(sum(p_retailprice), 6)::double as loc from part group by 1",
    "read_questions": "select source as repo, count(*) as n, count(*) as ids, count(*) as unanswered from documents where source is not null group by 1",
    "read_configuration": """select n_name as name, n_nationkey::varchar as key, '[".py"]' as extensions, row_number() over (order by n_nationkey) = 4 as asked from nation""",
}

QUERIES = {
    f.__name__: f
    for f in (
        read_documents, read_labels, read_second_scores, read_coverage, read_report_auc, read_issues, read_commit_log, read_file_lines, read_json_lines, read_class_metrics, read_questions, read_configuration,
    )
}
