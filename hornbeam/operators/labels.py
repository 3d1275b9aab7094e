"""Defect labels from history: fixes per file, bug origins through blamed lines, functions, and issue times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.functions import text


def fixes_per_file(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """``path, defect_count``: how many fix commits touch each file."""
    return files.select("sha", "path").distinct().join(fixes.select("sha"), "sha", "left_semi").groupBy("path").agg(F.count("*").alias("defect_count"))


def origins(hunks: DataFrame, blame: DataFrame, ancestors: DataFrame | None, fixes: DataFrame) -> DataFrame:
    """``fix_sha, file, lineno, blamed, plain, strict`` for every line that a fix takes away and history can name.

    ``plain`` needs the blamed commit to be an ancestor; ``strict`` moreover drops cosmetic lines and lines that a fix
    brought in.  Hunks meet lines by commit and file first, so the range condition is checked within a file only.
    """
    h, b = hunks.alias("h"), blame.alias("b")
    lines = b.join(h, (F.col("b.fix_sha") == F.col("h.fix_sha")) & (F.col("b.file") == F.col("h.file")) & F.col("b.lineno").between(F.col("h.start"), F.col("h.start") + F.col("h.lines") - 1), "left_semi")
    if ancestors is not None:
        lines = lines.join(ancestors.select(F.col("sha").alias("blamed")), "blamed", "left_semi")
    fix = fixes.select(F.col("sha").alias("blamed")).distinct().withColumn("__fix", F.lit(True))
    lines = lines.join(fix, "blamed", "left")
    strict = ~text.is_cosmetic(F.col("content"), text.extension(F.col("file"))) & F.col("__fix").isNull()
    return lines.select("fix_sha", "file", "lineno", "blamed", strict.alias("strict"))


def szz_counts(origin: DataFrame) -> DataFrame:
    """``file, plain, strict``: distinct fixes that point at each file, in both variants."""
    return origin.groupBy("file").agg(F.countDistinct("fix_sha").alias("plain"), F.countDistinct(F.when(F.col("strict"), F.col("fix_sha"))).alias("strict"))


def szz_summary(origin: DataFrame) -> DataFrame:
    """Inducing commits of both variants, and the fixes that have any (by the plain variant, for both)."""
    return origin.agg(
        F.countDistinct("blamed").alias("inducing_plain"), F.countDistinct(F.when(F.col("strict"), F.col("blamed"))).alias("inducing_strict"), F.countDistinct("fix_sha").alias("attributed")
    )


def lines_in_functions(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``lines(file, lineno, ...)`` with the function whose span holds them."""
    cond = (F.col("l.file") == F.col("s.file")) & F.col("l.lineno").between(F.col("s.start_line"), F.col("s.end_line"))
    return lines.alias("l").join(spans.alias("s"), cond).select("l.*", F.col("s.function_id"))


def function_process(blamed: DataFrame, spans: DataFrame, t0: int, recent_days: int = 90) -> DataFrame:
    """``function_id, mod_count, recent_mods, age_days`` from lines with their commit and time."""
    x = lines_in_functions(blamed, spans)
    recent = F.col("ts") >= t0 - recent_days * 86400
    age = F.round((t0 - F.median(F.when(F.col("ts") > 0, F.col("ts")))) / 86400.0, 1)
    return x.groupBy("function_id").agg(F.countDistinct("sha").alias("mod_count"), F.countDistinct(F.when(recent, F.col("sha"))).alias("recent_mods"), age.alias("age_days"))


def function_labels(removed: DataFrame, at_t0: DataFrame, spans: DataFrame) -> DataFrame:
    """``function_id, defect_count, label``: fixes whose removed lines are, by commit and content, lines of a function.

    ``removed(file, fix_sha, sha, content)`` and ``at_t0(file, lineno, sha, content)`` meet on the file, the commit and
    the content without white space; blank content meets nothing.
    """
    key = lambda d: d.withColumn("__f", text.fingerprint(F.col("content"))).where("__f <> ''")
    here = lines_in_functions(key(at_t0), spans).select("file", "sha", "__f", "function_id").distinct()
    hit = key(removed).join(here, ["file", "sha", "__f"]).groupBy("function_id").agg(F.countDistinct("fix_sha").alias("defect_count"))
    return spans.select("function_id").join(hit, "function_id", "left").fillna(0, ["defect_count"]).withColumn("label", (F.col("defect_count") > 0).cast("int"))


def first_confirmed(fixes: DataFrame, issues: DataFrame, confirmed: Column) -> DataFrame:
    """``sha, number, hours``: for each fix the first of its issue references that is confirmed."""
    refs = fixes.select("sha", F.posexplode(text.issue_refs(F.col("subject"))).alias("pos", "number"))
    found = refs.join(issues.where(confirmed), "number")
    return found.groupBy("sha").agg(F.min_by(F.struct("number", "hours"), "pos").alias("x")).select("sha", "x.number", "x.hours")


def link_meta(fixes: DataFrame, tickets: DataFrame) -> DataFrame:
    """``n_fixes, n_with_ref, n_linked, n_tickets, n_pr_tickets, n_issue_tickets`` of fixes ``(sha, subject)``.

    A fix is linked to the first of its references that is among ``tickets(number, is_pr)``, those with a time; tickets
    are the distinct ones of these, and the last two count fixes by the kind of theirs.
    """
    refs = fixes.select("sha", F.posexplode_outer(text.issue_refs(F.col("subject"))).alias("pos", "number"))
    known = tickets.select(F.col("number").alias("__t"), F.coalesce("is_pr", F.lit(False)).alias("is_pr")).withColumn("__hit", F.lit(True))
    found = refs.join(known, F.col("number") == F.col("__t"), "left")
    per = found.groupBy("sha").agg(F.count("number").alias("refs"), F.min_by(F.struct("number", "is_pr"), F.when(F.col("__hit"), F.col("pos"))).alias("t"))
    return per.agg(
        F.count("*").alias("n_fixes"), F.count_if(F.col("refs") > 0).alias("n_with_ref"), F.count("t").alias("n_linked"), F.countDistinct("t.number").alias("n_tickets"),
        F.count_if("t.is_pr").alias("n_pr_tickets"), F.count_if(~F.col("t.is_pr")).alias("n_issue_tickets"),
    )


def last_before(commits: DataFrame, when: Column) -> DataFrame:
    """The last commit at or before the end of a day, the greater id of equals."""
    return commits.where(F.col("ct") <= when).agg(F.max_by("sha", F.struct("ct", "sha")).alias("sha"), F.max("ct").alias("ct"))


def match_classes(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Class names ``a.b.C`` matched to files ``.../a/b/C.java``; nested classes belong to the file of the outer one."""
    outer = F.substring_index("name", "$", 1)
    return rows.withColumn("path", F.concat(F.replace(outer, F.lit("."), F.lit("/")), F.lit(".java"))).join(files, "path")
