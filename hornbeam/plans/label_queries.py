"""Registered queries on text classifiers, labels and history, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hornbeam.functions import text as X
from hornbeam.operators import history_graph as G
from hornbeam.operators import labels as L
from hornbeam.operators.inference import indexed
from hornbeam.sources import history as H
from hornbeam.sources.tables import COMMITS_SQL, FILES_SQL, commit_files, commits, read

# Templates of subjects, paths, lines and messages.  The queries fill them from the columns of whole tables.
SUBJECTS = (
    "fix: crash in {a}", "Fixed #{a} crash", "fixes #{a}", "closes #{a} and closes  #{b}", "resolves x{a}", "resolve: #{a} (#{b})", "fix typo in docs", "dispatch bugfix {a}", "Merge fix branch {a}",
    "merged the bug {a}", "fix(deps): bump x to {a}", "fix dep {a}", "fix doc {a}", "Bug {a}: patch it", "see #{a} (#{b})", "Fixes:#{b} (#{a})", "prefixes #{a}", "foreclose #{a}, fixed #{b}, closed: #{a}",
    "\U0001f41b squash {a}", "patchwork {a}", "PATCH {a} #{b} #{a}", "reformat, then fix {a}", "format and fix {a}", "chore: fix {a}", "style fix {a}", "lint fix {a}", "fix #007 #7", "plain words {a}",
)
FOLDERS = ("src", "srcfoo", "/src/a/", "src/tests", "test", "lib/__mocks__", "lib/__tests__/x", "contest", "docs/vendor", "build/gen", "src/build/gen", "src\\win", "")
NAMES = ("test_a{k}.py", "test_a{k}.go", "a{k}_test.go", "a{k}_test.java", "a{k}_test.rs", "_test.py", "a{k}.spec.ts", "a{k}.test.py", "a{k}.spec.mts", "conftest.py", "conftest.pyc", "a{k}.py", "README", "tests/")
LINES = ("x = {k}", "# note {k}", "// note {k}", "* {k}", "/* {k}", "*/", "}", "});", "} ;", "  ", "\t{ }\t", "\t[],\t", '""" {k}', "''' {k}", "-- {k}", "return {k} # no")
EXTENSIONS = (".py", ".rb", ".sh", ".js", ".jsx", ".tsx", ".mts", ".cts", ".cc", ".h", ".hpp", ".cs", ".kt", ".sql", ".lua", ".rs", "")
MESSAGES = (
    "Error 429: Too Many Requests", "rate-limit of {k}", "RATE LIMIT", "ratelimit", "rate  limit {k}", "usage limit reached", "no billing address {k}", "please Try Again in {k} s", "RESOURCE_EXHAUSTED", "exceeded the daily quota of {k}",
    "quota of {k} exceeded", "request was throttled", "Overloaded", "at capacity", "status 529", "retry after {k}", "file not found", "ok",
)
T0 = 880000000


def _pick(items, at):
    """The item at a position, which wraps around."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(at, F.lit(len(items))) + 1).cast("int"))


def _fill(template, **values):
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), v.cast("string"))
    return template


def subjects(spark, d):
    """``sha, author, priority, subject``: every commit with a subject made of its columns."""
    k = F.col("sha")
    return commits(spark, d).withColumn("subject", _fill(_pick(SUBJECTS, k), a=F.pmod(k, F.lit(97)), b=F.pmod(k, F.lit(31))))


def _history(spark, d):
    """A history made from orders and lines: urgent orders are fixes, their lines are removed lines that blame others."""
    line = read(spark, d, "lineitem")
    file = F.concat(F.lit("src/f"), F.pmod("l_partkey", F.lit(97)).cast("string"), F.when(F.pmod("l_partkey", F.lit(3)) == 0, ".py").otherwise(".js"))
    content = F.when(F.pmod("l_suppkey", F.lit(5)) == 0, "# note").when(F.pmod("l_suppkey", F.lit(5)) == 1, " } ").when(F.pmod("l_suppkey", F.lit(5)) == 2, "").otherwise(F.concat(F.lit("x =  "), F.col("l_quantity").cast("int").cast("string")))
    lines = line.select(F.col("l_orderkey").alias("fix_sha"), file.alias("file"), (F.col("l_linenumber") * 3).alias("lineno"), F.pmod(F.col("l_orderkey") * 7 + F.col("l_suppkey"), F.lit(9000)).alias("blamed"), content.alias("content"))
    fixes = commits(spark, d).where("priority = '1-URGENT'").select("sha")
    blame = lines.join(fixes.withColumnRenamed("sha", "fix_sha"), "fix_sha", "left_semi")
    hunks = blame.where("lineno % 2 = 1").select("fix_sha", "file", (F.col("lineno") - 1).alias("start"), F.lit(3).alias("lines"))
    return hunks, blame, t0_ancestors(spark, d), fixes


def parents(spark, d):
    """``sha, parent, position``: in order of time a commit follows the one 40 before it, on one of 40 lanes, and one in 29
    merges another lane; one in 211 of the first parents is missing, as in a shallow clone."""
    at = indexed(commits(spark, d), [], ["ct", "sha"], "i").select("sha", "i")
    to = at.select(F.col("sha").alias("parent"), F.col("i").alias("j"))
    pairs = F.array(F.struct(F.lit(0).alias("position"), (F.col("i") - 40).alias("j")), F.struct(F.lit(1).alias("position"), F.when(F.col("i") % 29 == 0, F.col("i") - 1 - F.col("i") % 37).alias("j")))
    wanted = at.select("sha", F.inline(pairs)).where("j is not null")
    return wanted.join(to, "j", "left").select("sha", F.when((F.col("position") == 0) & (F.col("j") % 211 == 0), -F.col("sha")).otherwise(F.col("parent")).alias("parent"), "position").where("parent is not null")


def t0_ancestors(spark, d):
    """What is reachable from the last commit at or before T0."""
    start = L.last_before(commits(spark, d), F.lit(T0)).select("sha")
    return G.ancestors(commits(spark, d).select("sha", "ct"), parents(spark, d), start, "ct")


def szz_files(spark, d):
    return L.szz_counts(L.origins(*_history(spark, d)))


def szz_summary(spark, d):
    return L.szz_summary(L.origins(*_history(spark, d)))


def fixes_per_file(spark, d):
    fixes = commits(spark, d).where("priority = '1-URGENT'")
    return L.fixes_per_file(fixes, commit_files(spark, d))


def prior_fixes(spark, d):
    """Fixes per file in the window before T0; all zero, so no row, where no commit is older than the window."""
    c = commits(spark, d).where(F.col("ct").between(T0 - 180 * 86400, T0) & (F.col("priority") == "1-URGENT"))
    return L.fixes_per_file(c, commit_files(spark, d))


def recent_commits(spark, d):
    """Commits of the 90 days before T0 for each file; roots and extensions are not looked at."""
    c = commits(spark, d).where(F.col("ct").between(T0 - 90 * 86400, T0)).select("sha")
    return commit_files(spark, d).select("sha", "path").distinct().join(c, "sha", "left_semi").groupBy("path").agg(F.count("*").alias("commits"))


def t0_resolution(spark, d):
    return L.last_before(commits(spark, d), F.unix_timestamp(F.lit("1996-06-30 23:59:59")))


def fix_classifier(spark, d):
    """All strategies over the subjects of all commits; ``custom`` has terms of its own."""
    c = F.col("subject")
    custom = X.is_fix(c, include=X.words(["crash", "words"]), exclude=X.words(["plain"]))
    return subjects(spark, d).select("sha", X.is_fix(c).alias("keyword"), X.is_fix(c, "prefix").alias("prefix"), X.is_fix(c, "gitmoji").alias("mark"), custom.alias("custom"))


def fix_commits(spark, d):
    return subjects(spark, d).groupBy("priority").agg(F.count("*").alias("commits"), F.count_if(X.is_fix(F.col("subject"))).alias("fixes"))


def issue_refs(spark, d):
    return subjects(spark, d).select("sha", F.array_join(F.transform(X.issue_refs(F.col("subject")), lambda x: x.cast("string")), ",").alias("refs"))


def path_rules(spark, d):
    """Paths made of the numbers of all parts."""
    k = F.col("p_partkey")
    name = _fill(_pick(NAMES, F.floor(k / len(FOLDERS))), k=F.pmod(k, F.lit(5)))
    p = read(spark, d, "part").select("p_partkey", F.concat_ws("/", F.nullif(_pick(FOLDERS, k), F.lit("")), name).alias("path"), "p_size")
    n = X.normalise_path(F.col("path"))
    return p.select(
        "p_partkey", "path", n.alias("normal"), X.is_test_file(F.col("path")).alias("test"), X.should_include(F.col("path"), F.col("p_size")).alias("included"),
        X.ignored(n, ["# folders", "vendor/", "build/gen/"]).alias("ignored"), X.in_source(n, "src", [".py", ".go"]).alias("source"), X.extension(n).alias("ext"), X.first_folder(F.col("path"), "src/").alias("folder"),
    )


def url_paths(spark, d):
    """Path functions over a whole table: the first folder and extension of page addresses."""
    path = X.normalise_path(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    rows = read(spark, d, "pages").select(path.alias("path"))
    return rows.groupBy(X.first_folder(F.col("path"), "").alias("folder"), X.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


def cosmetic_lines(spark, d):
    """Source lines made of all orders' lines, in files of many kinds."""
    line = _fill(_pick(LINES, F.col("l_orderkey") * 3 + F.col("l_linenumber")), k=F.pmod("l_suppkey", F.lit(3)))
    v = read(spark, d, "lineitem").select(line.alias("line"), _pick(EXTENSIONS, F.col("l_partkey")).alias("ext"))
    return v.groupBy("line", "ext", X.is_cosmetic(F.col("line"), F.col("ext")).alias("cosmetic")).agg(F.count("*").alias("n"))


def hunk_headers(spark, d):
    """Hunk headers made of all orders' lines; an absent count is 1, a count of 0 and other lines are left out."""
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(4))
    old = F.concat(F.col("l_suppkey").cast("string"), F.when(kind > 0, F.concat(F.lit(","), F.pmod("l_partkey", F.lit(3)).cast("string"))).otherwise(""))
    line = F.when(kind == 3, F.concat(F.lit("-@@ -"), old, F.lit(" +4 @@"))).otherwise(F.concat(F.lit("@@ -"), old, F.when(kind == 1, " +7,2").otherwise(" +7"), F.lit(" @@ def f")))
    v = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.hunk(line).alias("h")).where("h is not null and h.lines > 0")
    return v.groupBy("h.start", "h.lines").agg(F.count("*").alias("n"))


def blame_headers(spark, d):
    """Porcelain blame headers made of all orders; every third line is another field."""
    k = F.col("o_orderkey")
    sha = F.concat(F.md5(k.cast("string")), F.lit("0123abcd"))
    line = F.when(k % 3 == 0, F.concat(F.lit("author "), sha)).otherwise(F.concat_ws(" ", sha, F.lit("7"), F.pmod("o_custkey", F.lit(50)).cast("string"), F.when(k % 3 == 1, F.lit("2"))))
    return read(spark, d, "orders").select(X.blame(line).alias("b")).where("b is not null").select("b.lineno", "b.sha")


def issue_links(spark, d):
    """For each fix the first reference that is a closed bug with a time."""
    subjects = commits(spark, d).where("priority = '1-URGENT'").select("sha", F.concat(F.lit("#"), (F.col("sha") % 5).cast("string"), F.lit(" (#"), (F.col("sha") % 7).cast("string"), F.lit("), closes #"), (F.col("sha") % 50).cast("string")).alias("subject"))
    o = read(spark, d, "orders").where("o_orderkey % 4 <> 0")
    issues = o.groupBy((F.col("o_orderkey") % 50).alias("number")).agg(F.round(F.avg("o_totalprice"), 2).alias("hours"))
    return L.first_confirmed(subjects, issues, F.col("number") % 3 != 0)


def bug_issues(spark, d):
    """Every order as an issue: absent, a pull request, or labelled in several ways."""
    k = F.col("o_orderkey")
    labels = F.when(k % 4 == 0, F.array(F.lit("Bug"))).when(k % 4 == 1, F.array(F.lit("p1"), F.lit("type: Regression"))).when(k % 4 == 2, F.array(F.lit("feature"))).otherwise(F.array().cast("array<string>"))
    missing, is_pr = F.when(k % 13 > 1, k % 13 == 2), F.when(k % 7 > 1, k % 7 == 2)
    return read(spark, d, "orders").where(X.is_bug_issue(missing, is_pr, labels)).select(k.alias("number"))


def resolution_hours(spark, d):
    """Hours from order to shipment of closed orders, per customer: mean and median, none negative."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    line = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    x = o.where("o_orderstatus = 'F'").join(line, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("hours", X.hours_between(F.col("o_orderdate"), F.col("closed"))).where("hours >= 0")
    return x.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("hours"), 4).alias("mean_hours"), F.round(F.median("hours"), 4).alias("median_hours"))


def link_meta(spark, d):
    """How fixes stand to issues: with a reference, linked to one with a time, and the distinct ones of either kind."""
    fixes = subjects(spark, d).where(X.is_fix(F.col("subject"))).select("sha", "subject")
    tickets = read(spark, d, "orders").where("o_orderkey % 4 <> 0").groupBy((F.col("o_orderkey") % 97).alias("number")).agg(F.round(F.avg("o_totalprice"), 2).alias("hours"))
    return L.link_meta(fixes, tickets.withColumn("is_pr", F.col("number") % 3 == 0))


def function_floor(spark, d):
    """Functions that are long enough, per file: the orders' lines as functions of so many lines as their number says."""
    f = read(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("file"), F.col("l_linenumber").alias("nloc"))
    return H.function_floor(f).groupBy("file").agg(F.count("*").alias("functions"), F.min("nloc").cast("long").alias("shortest"))


def tree_at_t0(spark, d):
    """The sources of a tree that are neither tests nor ignored."""
    listing = path_rules(spark, d).select("path")
    found = H.tree_files(listing, "src", [".py", ".go"], ["**/gen/**", "a[1-2].*", "!a2.py"])
    return found.groupBy("path").agg(F.count("*").alias("n"))


def bucket_resolution(spark, d):
    """Mean and median hours of each health bucket, and the alert to healthy ratios."""
    from hornbeam.operators.groups import category
    from hornbeam.sources.tables import units

    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    x = line.join(o, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("hours", X.hours_between(F.col("o_orderdate"), F.col("l_shipdate"))).where("hours >= 0")
    per = x.groupBy("l_partkey").agg(F.avg("hours").alias("hours"))
    j = units(spark, d).join(per, F.col("unit_id") == F.col("l_partkey")).groupBy(category(F.col("score")).alias("bucket")).agg(F.count("*").alias("files"), F.avg("hours").alias("mean"), F.median("hours").alias("median"))
    h = j.where("bucket = 'healthy'").select(F.col("mean").alias("hm"), F.col("median").alias("hd"))
    out = j.crossJoin(F.broadcast(h))
    return out.select("bucket", "files", *(F.round(c, 4).alias(c) for c in ("mean", "median")), F.round(F.try_divide("mean", "hm"), 6).alias("mean_ratio"), F.round(F.try_divide("median", "hd"), 6).alias("median_ratio"))


def _function_inputs(spark, d):
    """Spans of ten lines in each file; lines at T0 with commit, time and content; lines that fixes removed."""
    line = read(spark, d, "lineitem")
    file = F.pmod("l_partkey", F.lit(97))
    spans = line.select(file.alias("file")).distinct().select("file", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    spans = spans.select("file", (F.col("file") * 10 + F.col("i")).alias("function_id"), (F.col("i") * 10 + 1).alias("start_line"), (F.col("i") * 10 + 8).alias("end_line"))
    at = line.select(
        file.alias("file"), (F.pmod("l_orderkey", F.lit(100)) + 1).alias("lineno"), F.pmod("l_orderkey", F.lit(500)).alias("sha"), F.unix_timestamp("l_shipdate").alias("ts"),
        F.concat(F.lit("v  = "), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("content"),
    )
    removed = line.where("l_returnflag = 'R' and l_discount >= 0.085").select(
        file.alias("file"), F.col("l_orderkey").alias("fix_sha"), F.pmod(F.col("l_orderkey") + 1, F.lit(500)).alias("sha"), F.concat(F.lit(" v ="), F.lit(" "), F.pmod("l_linenumber", F.lit(4)).cast("string")).alias("content")
    )
    return spans, at, removed


def function_process(spark, d):
    spans, at, _ = _function_inputs(spark, d)
    return L.function_process(at, spans, T0)


def function_labels(spark, d):
    spans, at, removed = _function_inputs(spark, d)
    return L.function_labels(removed, at, spans)


def class_match(spark, d):
    """Class names made of parts against files made of suppliers: what matches and what share."""
    rows = read(spark, d, "part").select(F.concat(F.lit("org.p"), F.pmod("p_partkey", F.lit(40)).cast("string"), F.lit(".C"), F.pmod("p_partkey", F.lit(9)).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "$In").otherwise("")).alias("name"), "p_size")
    files = read(spark, d, "supplier").select(F.concat(F.lit("org/p"), F.pmod("s_suppkey", F.lit(40)).cast("string"), F.lit("/C"), F.pmod("s_suppkey", F.lit(9)).cast("string"), F.lit(".java")).alias("path")).distinct()
    n = rows.count()
    return L.match_classes(rows, files).groupBy("path").agg(F.count("*").alias("classes"), F.round(100 * F.count("*") / F.lit(n), 6).alias("pct"))


def rate_limits(spark, d):
    """Messages, one for each event, that say a service was asked too often."""
    message = _fill(_pick(MESSAGES, F.col("event_id")), k=F.pmod("user_id", F.lit(3)))
    return read(spark, d, "events").select(message.alias("message")).groupBy("message", X.is_rate_limited(F.col("message")).alias("limited")).agg(F.count("*").alias("n"))


def coverage_meta(spark, d):
    """How a second scorer's cache stands to the units: paired, told to be nothing to score, absent, and defective pairs."""
    from hornbeam.sources.readers import pairing
    from hornbeam.sources.tables import units

    u = units(spark, d)
    other = u.where("unit_id % 10 <> 0").select("unit_id", F.when(F.col("unit_id") % 7 != 0, F.col("rival")).alias("score"))
    p = pairing(u, other, ["unit_id"])
    flag = lambda s: F.count_if(F.col("state") == s).alias(s + "_files")
    return p.groupBy("cluster").agg(F.count("*").alias("scored"), flag("paired"), flag("null"), flag("absent"), F.count_if((F.col("state") == "paired") & (F.col("defects") > 0)).alias("defective"))


def audit(spark, d):
    """Fixes, files, files that are no tests, a verdict, and the four folders touched most, of each author."""
    f = commit_files(spark, d).join(commits(spark, d).where("priority = '1-URGENT'").select("sha", "author"), "sha")
    f = f.withColumn("test", F.lower("path").rlike("/(test|spec)s?/") | F.lower(F.substring_index("path", "/", -1)).contains("test") | F.col("path").contains("/d7/"))
    folder = f.withColumn("folder", F.concat_ws("/", F.slice(F.split("path", "/"), 1, 2)))
    top = folder.groupBy("author", "folder").agg(F.count("*").alias("c")).groupBy("author").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "folder"))), 1, 4).alias("t"))
    base = f.groupBy("author").agg(F.countDistinct("sha").alias("fixes"), F.countDistinct("path").alias("files"), F.countDistinct(F.when(~F.col("test"), F.col("path"))).alias("plain_files"))
    return base.join(top, "author").select("author", "fixes", "files", "plain_files", (F.col("plain_files") >= 5).alias("usable"), F.array_join(F.transform("t", lambda x: x["folder"]), ",").alias("folders"))


_LIST = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
_S = f"""{COMMITS_SQL}, s as (select sha, priority, replace(replace({_LIST(SUBJECTS)}[sha % {len(SUBJECTS)} + 1], '{{a}}', (sha % 97)::varchar), '{{b}}', (sha % 31)::varchar) as subject from c)"""
_FIX = r"""(not regexp_matches(subject, '(?i)^merge |\b(typo|bump|dep|deps|chore|lint|format|style|doc|docs)\b')
  and regexp_matches(subject, '(?i)\b(fix|bug|patch|resolve|resolves)\b|(close|closes|fixe|fixes)\s+#[0-9]'))"""
_ANCESTORS = f"""ci as (select sha, row_number() over (order by ct, sha) - 1 as i from c),
pe as (select sha, 0 as position, i - 40 as j from ci union all select sha, 1, i - 1 - i % 37 from ci where i % 29 = 0),
par as (select pe.sha, case when position = 0 and j % 211 = 0 then -pe.sha else p.sha end as parent from pe left join ci p on p.i = pe.j),
anc as (select sha from (select sha from c where ct <= {T0} order by ct desc, sha desc limit 1) union select c.sha from anc join par on par.sha = anc.sha join c on c.sha = par.parent)"""
_HIST = f"""with recursive {COMMITS_SQL}, {_ANCESTORS}, ln as (select l_orderkey as fix_sha, 'src/f' || (l_partkey % 97) || case when l_partkey % 3 = 0 then '.py' else '.js' end as file, l_linenumber * 3 as lineno,
  (l_orderkey * 7 + l_suppkey) % 9000 as blamed, case l_suppkey % 5 when 0 then '# note' when 1 then ' }} ' when 2 then '' else 'x =  ' || l_quantity::int end as content from lineitem),
fx as (select sha from c where priority = '1-URGENT'), bl as (select * from ln where fix_sha in (select sha from fx)),
hk as (select fix_sha, file, lineno - 1 as start, 3 as lines from bl where lineno % 2 = 1),
og as (select fix_sha, file, lineno, blamed, trim(content) <> '' and trim(content) not in ('}}') and not (file like '%.py' and trim(content) like '#%')
  and blamed not in (select sha from fx) as strict from bl
  where exists (select 1 from hk where hk.fix_sha = bl.fix_sha and hk.file = bl.file and bl.lineno between hk.start and hk.start + hk.lines - 1) and blamed in (select sha from anc))"""
_FN = """with sp as (select file, file * 10 + i as function_id, i * 10 + 1 as start_line, i * 10 + 8 as end_line from (select distinct l_partkey % 97 as file from lineitem), range(10) r(i)),
at0 as (select l_partkey % 97 as file, l_orderkey % 100 + 1 as lineno, l_orderkey % 500 as sha, epoch(l_shipdate)::bigint as ts, 'v = ' || (l_suppkey % 4) as content from lineitem),
rm as (select l_partkey % 97 as file, l_orderkey as fix_sha, (l_orderkey + 1) % 500 as sha, 'v = ' || (l_linenumber % 4) as content from lineitem where l_returnflag = 'R' and l_discount >= 0.085)"""
SQL = {
    "t0_ancestors": f"with recursive {COMMITS_SQL}, {_ANCESTORS} select sha from anc",
    "szz_files": _HIST + " select file, count(distinct fix_sha) as plain, count(distinct fix_sha) filter (strict) as strict from og group by 1",
    "szz_summary": _HIST + " select count(distinct blamed) as inducing_plain, count(distinct blamed) filter (strict) as inducing_strict, count(distinct fix_sha) as attributed from og",
    "fixes_per_file": f"with {COMMITS_SQL}, {FILES_SQL} select path, count(distinct sha) as defect_count from cf join c using (sha) where priority = '1-URGENT' group by 1",
    "prior_fixes": f"with {COMMITS_SQL}, {FILES_SQL} select path, count(distinct sha) as defect_count from cf join c using (sha) where priority = '1-URGENT' and ct between {T0 - 180 * 86400} and {T0} group by 1",
    "recent_commits": f"with {COMMITS_SQL}, {FILES_SQL} select path, count(distinct sha) as commits from cf join c using (sha) where ct between {T0 - 90 * 86400} and {T0} group by 1",
    "t0_resolution": f"with {COMMITS_SQL}, x as (select * from c where ct <= epoch(timestamp '1996-06-30 23:59:59')) select sha, ct from x order by ct desc, sha desc limit 1",
    "fix_classifier": f"""with {_S} select sha, {_FIX} as keyword, starts_with(subject, 'Fixed #') as prefix, contains(subject, chr(128027)) as mark,
  (contains(subject, 'crash') or contains(subject, 'words')) and not contains(subject, 'plain') as custom from s""",
    "fix_commits": f"with {_S} select priority, count(*) as commits, count(*) filter ({_FIX}) as fixes from s group by 1",
    "issue_refs": "with " + _S + r""", a as (select sha, list_concat(regexp_extract_all(subject, '(?i)\b(close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved)\b[:\s]+#([0-9]+)', 2),
  regexp_extract_all(subject, '#([0-9]+)', 1)) as l from s), e as (select sha, unnest(l)::bigint as r, unnest(range(len(l))) as i from a), f as (select sha, r, min(i) as i from e group by 1, 2),
g as (select sha, string_agg(r, ',' order by i) as refs from f group by 1) select sha, coalesce(refs, '') as refs from s left join g using (sha)""",
    "path_rules": f"""with p as (select p_partkey, p_size, concat_ws('/', nullif({_LIST(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1], ''), replace({_LIST(NAMES)}[p_partkey // {len(FOLDERS)} % {len(NAMES)} + 1], '{{k}}', (p_partkey % 5)::varchar)) as path from part),
n as (select *, trim(replace(path, chr(92), '/'), '/') as normal from p), """ + r"""t as (select *, list_last(string_split(normal, '/')) as leaf, list_slice(string_split(normal, '/'), 1, -2) as up from n),
m as (select *, list_has_any(up, ['test', 'tests', '__tests__', '__mocks__']) or leaf = 'conftest.py' or (leaf like 'test\__%.py' escape '\') or (leaf like '_%\_test.py' escape '\') or (leaf like '_%\_test.go' escape '\')
  or (leaf like '_%\_test.rs' escape '\') or leaf similar to '.*\.(test|spec)\.(ts|tsx|js|jsx|mts|cts)' as test from t)
select p_partkey, path, normal, test, not test and p_size >= 10 as included, (list_contains(up, 'vendor') or starts_with(normal, 'build/gen/')) as ignored,
  starts_with(normal, 'src') and (normal like '%.py' or normal like '%.go') as source, case when contains(normal, '.') then '.' || list_last(string_split(normal, '.')) else '' end as ext,
  case when starts_with(normal, 'src/') then case when len(up) > 1 then up[2] else '<root>' end when len(up) > 0 then up[1] else '<root>' end as folder from m""",
    "url_paths": """with p as (select trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as p from pages)
select case when contains(p, '/') then split_part(p, '/', 1) else '<root>' end as folder, regexp_extract(p, '(\\.[^.]*)$', 1) as ext, count(*) as n from p group by 1, 2""",
    "issue_links": f"""with {COMMITS_SQL}, i as (select o_orderkey % 50 as number, round(avg(o_totalprice), 2) as hours from orders where o_orderkey % 4 <> 0 group by 1),
r as (select sha, unnest([sha % 50, sha % 5, sha % 7]) as number, unnest([0, 1, 2]) as pos from c where priority = '1-URGENT'),
j as (select sha, r.number, hours, row_number() over (partition by sha order by pos) as k from r join i on i.number = r.number where r.number % 3 <> 0) select sha, number, hours from j where k = 1""",
    "resolution_hours": """with l as (select l_orderkey, max(l_shipdate) as c from lineitem group by 1), x as (select o_custkey, (epoch(c) - epoch(o_orderdate)) / 3600 as h from orders join l on l_orderkey = o_orderkey where o_orderstatus = 'F')
select o_custkey, count(*) as n, round(avg(h), 4) as mean_hours, round(median(h), 4) as median_hours from x where h >= 0 group by 1""",
    "function_process": _FN + f""", x as (select function_id, sha, ts from at0 join sp on at0.file = sp.file and lineno between start_line and end_line)
select function_id, count(distinct sha) as mod_count, count(distinct sha) filter (ts >= {T0 - 90 * 86400}) as recent_mods, round(({T0} - median(ts) filter (ts > 0)) / 86400.0::double, 1) as age_days from x group by 1""",
    "function_labels": _FN + """, x as (select distinct at0.file, sha, content, function_id from at0 join sp on at0.file = sp.file and lineno between start_line and end_line),
h as (select function_id, count(distinct fix_sha) as n from rm join x using (file, sha, content) group by 1)
select sp.function_id, coalesce(n, 0) as defect_count, (coalesce(n, 0) > 0)::int as label from sp left join h on h.function_id = sp.function_id""",
    "class_match": """with r as (select 'org/p' || (p_partkey % 40) || '/C' || (p_partkey % 9) || '.java' as path from part), f as (select distinct 'org/p' || (s_suppkey % 40) || '/C' || (s_suppkey % 9) || '.java' as path from supplier)
select path, count(*) as classes, round(100.0::double * count(*) / (select count(*) from part), 6) as pct from r join f using (path) group by 1""",
    "cosmetic_lines": f"""with v as (select replace({_LIST(LINES)}[(l_orderkey * 3 + l_linenumber) % {len(LINES)} + 1], '{{k}}', (l_suppkey % 3)::varchar) as line, {_LIST(EXTENSIONS)}[l_partkey % {len(EXTENSIONS)} + 1] as ext from lineitem),
t as (select *, trim(line, ' ' || chr(9)) as b from v)
select line, ext, b in ('', '}}', '}});', '[],') or starts_with(b, '*') or starts_with(b, '/*') or starts_with(b, '\"\"\"') or starts_with(b, '''''''') or (starts_with(b, '#') and ext = '.py')
  or (starts_with(b, '//') and ext in ('.js', '.jsx', '.tsx', '.mts', '.cts', '.cc', '.h', '.hpp', '.cs', '.kt', '.rs')) as cosmetic, count(*) as n from t group by 1, 2, 3""",
    "hunk_headers": """with v as (select l_suppkey::int as start, (case when (l_orderkey + l_linenumber) % 4 = 0 then 1 else l_partkey % 3 end)::int as lines from lineitem where (l_orderkey + l_linenumber) % 4 < 3)
select start, lines, count(*) as n from v where lines > 0 group by 1, 2""",
    "blame_headers": "select (o_custkey % 50)::int as lineno, md5(o_orderkey::varchar) || '0123abcd' as sha from orders where o_orderkey % 3 <> 0",
    "bug_issues": "select o_orderkey as number from orders where o_orderkey % 4 in (0, 1) and o_orderkey % 13 <> 2 and o_orderkey % 7 <> 2",
}
from hornbeam.sources.tables import UNITS_SQL as _U  # noqa: E402

SQL["bucket_resolution"] = f"""with {_U}, x as (select l_partkey, avg(h) as hours from (select l_partkey, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 as h from lineitem join orders on o_orderkey = l_orderkey) where h >= 0 group by 1),
j as (select case when score >= 8 then 'healthy' when score < 4 then 'alert' else 'warning' end as bucket, count(*) as files, avg(hours) as m, median(hours) as d from u join x on unit_id = l_partkey group by 1),
h as (select m as hm, d as hd from j where bucket = 'healthy')
select bucket, files, round(m, 4) as mean, round(d, 4) as median, round(m / hm, 6) as mean_ratio, round(d / hd, 6) as median_ratio from j, h"""

SQL["rate_limits"] = f"""with v as (select replace({_LIST(MESSAGES)}[event_id % {len(MESSAGES)} + 1], '{{k}}', (user_id % 3)::varchar) as message from events)
select message, lower(message) similar to '.*(ratelimit|rate.limit|too many requests|429|overloaded|capacity|usagelimit|usage.limit|throttl|billing|try again|resource_exhausted).*'
  or (contains(message, 'exceeded') and instr(message, 'quota') > instr(message, 'exceeded')) as limited, count(*) as n from v group by 1, 2"""
SQL["link_meta"] = f"""with {_S}, fx as (select * from s where {_FIX}), l as (select sha, list_concat(regexp_extract_all(subject, '(?i)\\b(close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved)\\b[:\\s]+#([0-9]+)', 2),
  regexp_extract_all(subject, '#([0-9]+)', 1)) as l from fx), r as (select sha, unnest(l)::bigint as number, unnest(range(len(l))) as pos from l),
t as (select distinct o_orderkey % 97 as number from orders where o_orderkey % 4 <> 0), f as (select sha, arg_min(number, pos) as number from r join t using (number) group by 1)
select (select count(*) from fx) as n_fixes, (select count(*) from l where len(l) > 0) as n_with_ref, count(*) as n_linked, count(distinct number) as n_tickets,
  count(*) filter (number % 3 = 0) as n_pr_tickets, count(*) filter (number % 3 <> 0) as n_issue_tickets from f"""
SQL["function_floor"] = "select l_partkey % 97 as file, count(*) as functions, min(l_linenumber)::bigint as shortest from lineitem where l_linenumber >= 3 group by 1"
SQL["tree_at_t0"] = f"""with q as ({SQL["path_rules"]}) select normal as path, count(*) as n from q where source and not test
  and (not regexp_matches(normal, '(^|/)gen/') and not regexp_matches(normal, '(^|/)a[12][.][^/]*$') or regexp_matches(normal, '(^|/)a2[.]py$')) group by 1"""
SQL["coverage_meta"] = f"""with {_U}, s as (select *, case when unit_id % 10 = 0 then 'absent' when unit_id % 7 = 0 then 'null' else 'paired' end as st from u)
select cluster, count(*) as scored, count(*) filter (st = 'paired') as paired_files, count(*) filter (st = 'null') as null_files, count(*) filter (st = 'absent') as absent_files,
  count(*) filter (st = 'paired' and defects > 0) as defective from s group by 1"""
SQL["audit"] = f"""with {COMMITS_SQL}, {FILES_SQL}, f as (select author, sha, path, contains(path, '/d7/') as test, regexp_extract(path, '^[^/]*/[^/]*') as folder from cf join c using (sha) where priority = '1-URGENT'),
t as (select author, folder, row_number() over (partition by author order by count(*) desc, folder) as k from f group by 1, 2),
b as (select author, count(distinct sha) as fixes, count(distinct path) as files, count(distinct path) filter (not test) as plain_files from f group by 1)
select b.*, plain_files >= 5 as usable, folders from b join (select author, string_agg(folder, ',' order by k) as folders from t where k <= 4 group by 1) using (author)"""

QUERIES = {
    f.__name__: f
    for f in (
        t0_ancestors, szz_files, szz_summary, fixes_per_file, prior_fixes, recent_commits, t0_resolution, fix_classifier, fix_commits, issue_refs, path_rules, url_paths, cosmetic_lines, hunk_headers, blame_headers,
        issue_links, bug_issues, resolution_hours, bucket_resolution, function_process, function_labels, class_match, rate_limits, coverage_meta, audit, link_meta, function_floor, tree_at_t0,
    )
}
