"""Readers and writers for the documents the analytics take in and give out.

All go through Spark's own file sources, so any store that Spark reads will do; a cluster name comes from the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCORED_FILE = (
    "file_path string, health_score double, max_ccn int, max_nesting int, nloc int, has_test_file boolean, "
    "line_coverage_pct double, branch_coverage_pct double, duplication_pct double"
)
FINDING = "file_path string, biomarker_type string, severity string, health_impact double, details map<string,string>"
DOCUMENT = f"kpis map<string,string>, metrics array<struct<{SCORED_FILE.replace(' ', ':').replace(',:', ',')}>>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"
ISSUE = "number int, state string, labels array<string>, is_pr boolean, created_at timestamp, closed_at timestamp, title string, _missing boolean"
COVERAGE = "files map<string,struct<line_coverage_pct:double>>"


#: Ends a document where a file has many, as in JSON text sequences; no document has it inside, JSON escapes it.
RECORD = "\u001e"


def whole_texts(spark: SparkSession, paths: str | list[str], sep: str | None = None) -> DataFrame:
    """One text a file; with ``sep`` one for each document that it ends."""
    return spark.read.text(paths, wholetext=sep is None, lineSep=sep)


def cluster_of(marker: str) -> Column:
    """The folder after ``marker`` in the path of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), marker + "([^/]+)/", 1)


def health_documents(spark: SparkSession, paths: str | list[str], marker: str = "/health_defect_", sep: str | None = None) -> DataFrame:
    """``cluster, doc``: the JSON document within a tool's noisy output, from its first ``{"kpis"``.

    Output without one, or with a broken one, is a row with a null ``doc``.  A file is one output, or with ``sep`` many.
    """
    text = whole_texts(spark, paths, sep).select(cluster_of(marker).alias("cluster"), "value")
    at = F.instr("value", '{"kpis"')
    return text.select("cluster", F.when(at > 0, F.from_json(F.substr("value", at), DOCUMENT)).alias("doc"))


def scored_files(documents: DataFrame) -> DataFrame:
    """A row for each file of the documents, ``ord`` its place."""
    return documents.select("cluster", F.posexplode("doc.metrics").alias("ord", "m")).select("cluster", F.col("ord").cast("long").alias("ord"), "m.*")


def findings(documents: DataFrame) -> DataFrame:
    return documents.select("cluster", F.posexplode("doc.findings").alias("ord", "f")).select("cluster", F.col("ord").cast("long").alias("ord"), "f.*")


def joined_rows(spark: SparkSession, paths: str | list[str], schema: str, marker: str = "/health_defect_") -> DataFrame:
    """Rows of JSON arrays, one file each."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("cluster", cluster_of(marker))


def label_map(spark: SparkSession, paths: str | list[str], marker: str = "/health_defect_", sep: str | None = None) -> DataFrame:
    """``cluster, file_path, defect_count`` from objects of path to count; ``{}`` has no row."""
    text = whole_texts(spark, paths, sep).select(cluster_of(marker).alias("cluster"), F.from_json("value", "map<string,int>").alias("m"))
    return text.select("cluster", F.explode("m").alias("file_path", "defect_count"))


def with_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with their labels: paths in normal form on both sides, no label is 0."""
    from hornbeam.functions.text import normalise_path

    named = labels.select(F.col("cluster").alias("__c"), normalise_path(F.col("file_path")).alias("__p"), "defect_count")
    hit = F.col("cluster").eqNullSafe(F.col("__c")) & (normalise_path(F.col("file_path")) == F.col("__p"))
    return files.join(named, hit, "left").drop("__c", "__p").fillna(0, ["defect_count"])


def cached_issues(spark: SparkSession, paths: str | list[str], marker: str = "/health_defect_", lines: bool = False) -> DataFrame:
    """Issues cached one a file, or with ``lines`` one a line; number (where none is told) and cluster from the path; a cached
    404 has ``_missing`` true."""
    got = spark.read.schema(ISSUE).option("multiLine", not lines).json(paths)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]+)\.json$", 1).cast("int")
    return got.withColumn("cluster", cluster_of(marker)).withColumn("number", F.coalesce("number", number)).withColumn("_missing", F.coalesce("_missing", F.lit(False)))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, keys: list[str]) -> DataFrame:
    """Rows of JSON lines in order (``ord``); lines that are broken or lack a key are dropped."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    rows = lines.select("f", "i", F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).where("r._broken is null")
    for k in keys:
        rows = rows.where(F.col(f"r.{k}").isNotNull())
    return rows.select(F.struct("f", "i").alias("ord"), "r.*").drop("_broken")


def coverage(spark: SparkSession, paths: str | list[str], marker: str = "/health_defect_", lines: bool = False) -> DataFrame:
    """``cluster, file_path, line_coverage_pct`` of coverage artifacts, one a file or with ``lines`` one a line; a file without a
    number stays null, not 0."""
    got = spark.read.schema(COVERAGE).option("multiLine", not lines).json(paths).select(cluster_of(marker).alias("cluster"), F.explode("files").alias("file_path", "c"))
    return got.select("cluster", "file_path", "c.line_coverage_pct")


def second_scores(spark: SparkSession, paths: str | list[str], marker: str = "/health_defect_", sep: str | None = None) -> DataFrame:
    """``cluster, file_path, score`` of another scorer's cache; a null score (nothing to score) stays a row."""
    text = whole_texts(spark, paths, sep).select(cluster_of(marker).alias("cluster"), F.from_json("value", "map<string,double>").alias("m"))
    return text.select("cluster", F.explode("m").alias("file_path", "score"))


def pairing(files: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Files with the other scorer's ``score`` and how they stand: ``paired``, ``null`` (told, nothing to score), ``absent``."""
    told = other.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("score").alias("other_score"), F.lit(True).alias("__told"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = files.join(told, cond, "left")
    state = F.when(F.col("other_score").isNotNull(), "paired").when(F.col("__told"), "null").otherwise("absent")
    return out.withColumn("state", state).drop("__told", *(f"__{k}" for k in keys))


def ck_rows(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """CSV of class metrics with a header: numbers cast where they can be, else null."""
    raw = spark.read.option("header", True).csv(paths)
    return raw.select("name", *(F.col(c).try_cast("double").alias(c) for c in columns))


def questions(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Task rows of a JSON array, or with ``lines`` of one a line; an absent id becomes the row's place, absent texts are empty."""
    rows = spark.read.schema("id string, repo string, split_name string, question string, answer string").option("multiLine", not lines).json(paths)
    at = F.row_number().over(Window.partitionBy("repo").orderBy(F.monotonically_increasing_id())) - 1
    return rows.select(F.coalesce("id", F.concat_ws("-", "repo", at.cast("string"))).alias("id"), "repo", "split_name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")))


def nested_auc(spark: SparkSession, paths: str | list[str], label: str, marker: str = "/health_defect_") -> DataFrame:
    """One number out of report documents: the AUC under a label strategy."""
    text = spark.read.text(paths, wholetext=True)
    return text.select(cluster_of(marker).alias("cluster"), F.get_json_object("value", f"$.label_comparison.{label}.auc").cast("double").alias("auc"))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table with a header; texts are quoted where they hold a comma, a quote or a line end.  A null is nothing and an empty
    text a pair of quotes; Spark's reader takes both for null."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """A folder for each key, as raw outputs are kept."""
    df.write.mode("overwrite").partitionBy(*keys).json(path)
