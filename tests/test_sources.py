"""Readers on small files with the shapes and the dirt they meet."""

import json

from pyspark.sql import functions as F

from hornbeam.sources import readers as S


def put(tmp_path, cluster, name, text):
    folder = tmp_path / f"health_defect_{cluster}" / name.rpartition("/")[0]
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name.rpartition("/")[2]
    path.write_text(text)
    return str(path)


def test_health_documents(spark, tmp_path):
    doc = {"kpis": {"a": 1}, "metrics": [{"file_path": "a.py", "health_score": 8.5, "nloc": 3}, {"file_path": "b.py", "health_score": None}], "findings": [{"file_path": "a.py", "biomarker_type": "x", "severity": "low", "health_impact": 0.5, "details": {"v": "3"}}]}
    good = put(tmp_path, "r1", "out.txt", "warming up\n{not it}\n" + json.dumps(doc))
    bad = put(tmp_path, "r2", "out.txt", "nothing here")
    d = S.health_documents(spark, [good, bad])
    assert [(r["cluster"], r["ord"], r["file_path"], r["health_score"]) for r in S.scored_files(d).orderBy("ord").collect()] == [("r1", 0, "a.py", 8.5), ("r1", 1, "b.py", None)]
    assert S.findings(d).first()["details"] == {"v": "3"}
    assert [r["cluster"] for r in d.where("doc is null").collect()] == ["r2"]


def test_labels_and_caches(spark, tmp_path):
    labels = [put(tmp_path, "r1", "defects.json", '{"a.py": 2, "/b\\\\c.py": 1}'), put(tmp_path, "r2", "defects.json", "{}")]
    m = S.label_map(spark, labels)
    files = spark.createDataFrame([("r1", "b/c.py"), ("r1", "z.py"), ("r2", "a.py")], "cluster string, file_path string")
    assert sorted(map(tuple, S.with_labels(files, m).collect())) == [("r1", "b/c.py", 1), ("r1", "z.py", 0), ("r2", "a.py", 0)]
    issues = [put(tmp_path, "r1", "issues/7.json", '{"number": 7, "state": "closed", "labels": ["bug"], "is_pr": false}'), put(tmp_path, "r1", "issues/9.json", '{"_missing": true}')]
    assert sorted((r["number"], r["_missing"]) for r in S.cached_issues(spark, issues).collect()) == [(7, False), (9, True)]
    scores = put(tmp_path, "r1", "scores.json", '{"a.py": 3.5, "b.py": null}')
    got = S.pairing(spark.createDataFrame([("r1", x) for x in ("a.py", "b.py", "c.py")], "cluster string, file_path string"), S.second_scores(spark, scores), ["cluster", "file_path"])
    assert {r["file_path"]: r["state"] for r in got.collect()} == {"a.py": "paired", "b.py": "null", "c.py": "absent"}
    cov = put(tmp_path, "r1", "coverage.json", '{"files": {"a.py": {"line_coverage_pct": 50.0}, "b.py": {}}}')
    assert {r["file_path"]: r["line_coverage_pct"] for r in S.coverage(spark, cov).collect()} == {"a.py": 50.0, "b.py": None}
    report = put(tmp_path, "r1", "correlation.json", '{"label_comparison": {"szz": {"auc": 0.7}}}')
    assert S.nested_auc(spark, report, "szz").first()["auc"] == 0.7


def test_lines_csv_and_sinks(spark, tmp_path):
    lines = put(tmp_path, "r1", "runs.jsonl", '{"task": "a", "cond": "x", "v": 1}\n{broken\n{"cond": "x"}\n{"task": "a", "cond": "x", "v": 2}\n')
    rows = S.json_lines(spark, lines, "task string, cond string, v int", ["task"])
    from hornbeam.operators.paired import last_row_wins

    assert [r["v"] for r in last_row_wins(rows, ["task", "cond"], "ord").collect()] == [2]
    csv = put(tmp_path, "r1", "ck.csv", "name,wmc,bug\na.B,3,1\nc.D,x,0\n")
    assert [tuple(r) for r in S.ck_rows(spark, csv, ["wmc", "bug"]).collect()] == [("a.B", 3.0, 1.0), ("c.D", None, 0.0)]
    tasks = put(tmp_path, "r1", "tasks.json", '[{"repo": "r", "question": "q"}, {"id": "k", "repo": "r", "answer": "a"}]')
    assert sorted((r["id"], r["question"]) for r in S.questions(spark, tasks).collect()) == [("k", ""), ("r-0", "q")]
    out = str(tmp_path / "sink")
    S.append_results(rows.select("task", "cond", "v"), out)
    S.append_results(rows.select("task", "cond", "v"), out)
    assert spark.read.json(out).count() == 4
    S.write_by_key(rows.select("task", "cond", "v"), str(tmp_path / "keyed"), ["task", "cond"])
    assert set(spark.read.json(str(tmp_path / "keyed")).columns) == {"task", "cond", "v"}
    S.write_report(rows.select("v"), str(tmp_path / "report"))
    S.write_csv(spark.createDataFrame([("a,\"b\"\nc", 1), (None, None), ("", 2)], "t string, n int"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("t string, n int").csv(str(tmp_path / "csv"))
    assert {tuple(r) for r in back.collect()} == {("a,\"b\"\nc", 1), (None, None), (None, 2)}


def test_streams(spark, tmp_path):
    from hornbeam.streaming import streams as T

    source = str(tmp_path / "in")
    spark.createDataFrame([("t", "c", 1), ("t", "c", 2), ("u", "c", 3)], "task string, cond string, at int").select("task", "cond", F.timestamp_seconds("at").alias("ts")).write.parquet(source)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # a second run resumes and adds nothing
        T.appended(T.once_by_key(T.event_stream(spark, source), ["task", "cond"], "ts"), out, mark)
    assert spark.read.json(out).count() == 2
    seen = []
    T.each_batch(T.event_stream(spark, source), lambda df, n: seen.append(df.count()), str(tmp_path / "mark2"))
    assert sum(seen) == 3


def test_ignore_rules(spark):
    from hornbeam.functions import text as X

    rules = ["# comment", "", "docs/", "/top.py", "a/**/z.py", "*.gen.js", "**/deep", "lib/**", "x[0-9]?.c", "!keep.gen.js", "sp ace.txt  "]
    cases = {
        "docs/a.md": True, "b/docs/c/d": True, "docs": False, "top.py": True, "b/top.py": False, "a/z.py": True, "a/b/c/z.py": True, "q/a/z.py": False, "k/m.gen.js": True, "k/keep.gen.js": False,
        "q/deep/r": True, "deep": True, "lib/a/b": True, "q/lib/a": False, "x1y.c": True, "xay.c": False, "sp ace.txt": True, "plain": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", X.ignored(F.col("p"), rules).alias("i")).collect()
    assert {r["p"]: r["i"] for r in rows} == cases
    assert not spark.range(1).select(X.ignored(F.lit("a"), [])).first()[0]


def test_history_readers(spark, tmp_path):
    from hornbeam.sources import history as H

    (tmp_path / "log").write_text("a1\0fix: x\0y\n\nb2\0\nc3\n\0lost\n")
    assert sorted(map(tuple, H.commit_log(spark, str(tmp_path / "log")).collect())) == [("a1", "fix: x\0y"), ("b2", ""), ("c3", "")]
    folder = tmp_path / "sha=a1"
    folder.mkdir()
    (folder / "files").write_text("src/a.py\n  src/b.py \nsrc/c.js\nlib/d.py\n\n")
    touched = H.touched_files(spark, [str(folder)], "/sha=", "src", [".py"])
    assert sorted(map(tuple, touched.collect())) == [("a1", "src/a.py"), ("a1", "src/b.py")]
    missing = str(tmp_path / "gone")
    assert H.existing(spark, [str(folder), missing]) == [str(folder)]
    lines = H.file_lines(spark.createDataFrame([("f", "a\n\nb"), ("g", ""), ("h", None)], "f string, content string")).collect()
    assert sorted(map(tuple, lines)) == [("f", 1, "a"), ("f", 2, ""), ("f", 3, "b"), ("g", 1, "")]
    (tmp_path / "empty.json").write_text("{}")
    assert H.configured(spark, str(tmp_path / "empty.json")).count() == 0


def test_many_documents_in_a_file(spark, tmp_path, sf_dir, monkeypatch):
    """A cluster's documents are many, so that none grows with the input (F2)."""
    from hornbeam.plans import reader_queries as Q

    doc = json.dumps({"kpis": {"a": 1}, "metrics": [{"file_path": "a.py", "health_score": 8.5}]})
    path = put(tmp_path, "r1", "out.txt", f"warming up\n{doc}{S.RECORD}nothing here{S.RECORD}again\n{doc}{S.RECORD}")
    d = S.health_documents(spark, path, sep=S.RECORD)
    assert d.count() == 3 and S.scored_files(d).count() == 2
    whole = sorted(map(tuple, Q.read_documents(spark, sf_dir).collect()))
    docs, read = [], S.health_documents
    monkeypatch.setattr(Q, "RUN", 20)
    monkeypatch.setattr(S, "health_documents", lambda *a: docs.append(read(*a)) or docs[-1])
    assert sorted(map(tuple, Q.read_documents(spark, sf_dir).collect())) == whole
    assert docs[0].count() > 4 * docs[0].select("cluster").distinct().count()
    assert docs[0].selectExpr("max(size(doc.metrics))").first()[0] <= 20
