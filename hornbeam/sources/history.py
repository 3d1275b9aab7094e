"""Readers for what version control and configuration tell: logs, touched files, trees, file contents, lists of sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions import text as X

#: Functions of fewer lines are not looked at.
MIN_FUNCTION_LINES = 3


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there: a cluster without its document is passed over, it is no error."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def configured(spark: SparkSession, path: str, section: str = "repos", name: str | None = None) -> DataFrame:
    """A row for each entry of a configuration's list (JSON, or YAML where its parser is installed), all values as text,
    lists and objects as JSON; with ``name`` only that entry.  A configuration is small: it is parsed by the driver."""
    whole = spark.read.text(path, wholetext=True).first()
    body = whole[0] if whole else ""
    try:
        document = json.loads(body)
    except ValueError:
        import yaml

        document = yaml.safe_load(body)
    entries = [e for e in (document or {}).get(section) or [] if name is None or e.get("name") == name]
    keys = list(dict.fromkeys(["name", *(k for e in entries for k in e)]))
    cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame([tuple(cell(e.get(k)) for k in keys) for e in entries], ", ".join(f"`{k}` string" for k in keys))


def commit_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``sha, subject`` of log lines with a NUL between the two; lines without a sha are dropped, a line without a NUL has
    an empty subject."""
    part = F.split("value", "\u0000", 2)
    rows = spark.read.text(paths).select(part[0].alias("sha"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("subject"))
    return rows.where("sha <> ''")


def touched_files(spark: SparkSession, paths: str | list[str], marker: str, root: str, extensions: list[str]) -> DataFrame:
    """``sha, path`` of lists of paths, one list a commit in a folder ``marker`` and the sha; only sources below the root."""
    rows = spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_path"), marker + "([^/]+)/", 1).alias("sha"), F.trim("value").alias("path"))
    return rows.where((F.col("path") != "") & X.in_source(F.col("path"), root, extensions))


def tree_files(listing: DataFrame, root: str, extensions: list[str], rules: list[str]) -> DataFrame:
    """``path`` of a listed tree in normal form: sources below the root that are neither tests nor ignored."""
    p = F.col("path")
    rows = listing.select(X.normalise_path(p).alias("path"))
    return rows.where((p != "") & X.in_source(p, root, extensions) & ~X.is_test_file(p) & ~X.ignored(p, rules))


def file_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """The other columns with ``lineno`` from 1 and ``line``; a null content has no lines, an empty one has one."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(F.split(content, "\n")).alias("lineno", "line")).withColumn("lineno", F.col("lineno") + 1)


def function_floor(functions: DataFrame, lines: Column | str = "nloc", least: int = MIN_FUNCTION_LINES) -> DataFrame:
    """Functions that are long enough; a file that has none left has no rows."""
    return functions.where((F.col(lines) if isinstance(lines, str) else lines) >= least)


def located(first: DataFrame, second: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows of the configured artifact for clusters that have one, else of the cached one; a cluster with neither has none.
    Both have the same columns."""
    rest = second.join(first.select(cluster).distinct(), cluster, "left_anti").select(*first.columns)
    return first.unionByName(rest)
