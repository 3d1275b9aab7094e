"""Path, subject, line and message rules on cases with known answers, written out by hand."""

import pytest
from pyspark.sql import functions as F

from hornbeam.functions import text as X


def check(spark, rule, cases):
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select("x", rule(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_fix_subjects(spark):
    check(spark, X.is_fix, {
        "fixes #3": True, "closes #7": True, "resolves x": True, "prefixes #3": True, "Merge fix branch": False, "fix dep": False, "fix docs": False, "fix doc": False, "fixed it": False, "Bug: x": True,
        "merge the fix": False, "unfixed": False, "fixé": False, "patch_1": False, "reformat, fix": True, "": False,
    })
    check(spark, lambda c: X.is_fix(c, "prefix"), {"Fixed #3": True, "fixed #3": False})
    check(spark, lambda c: X.is_fix(c, "gitmoji"), {"\U0001f41b x": True, "x": False})
    check(spark, lambda c: X.is_fix(c, include=X.words(["a.b"]), exclude=X.words(["no"])), {"x a.b": True, "x acb": False, "no a.b": False})


def test_issue_references(spark):
    check(spark, X.issue_refs, {"see #5 (#12)": [5, 12], "fixes:#3 (#1)": [3, 1], "(#1) fixes #3": [3, 1], "unfixed #9, #2": [9, 2], "foreclose #1, closed #2": [2, 1], "#07 #7": [7], "none": [], "#99999999999999999999 #1": [1]})


def test_test_paths(spark):
    check(spark, X.is_test_file, {
        "a/__mocks__/b.ts": True, "tests/x": True, "a/test/b": True, "contest/a.py": False, "test_a.py": True, "test_a.go": False, "a_test.go": True, "a_test.java": False, "a.test.ts": True, "a.test.py": False,
        "conftest.py": True, "x/conftest.pyc": False, "src\\tests\\a": True, "/tests/": False,
    })


@pytest.mark.parametrize("ext, line, cosmetic", [(".rb", "# x", False), (".py", "# x", True), (".jsx", "// x", True), (".hpp", "// x", True), (".sql", "-- x", False), (".c", "} ;", False), (".c", "});", True), ("", "\t \r", True), (".py", "''' x", True), (".py", "x = 1 # y", False)])
def test_cosmetic_lines(spark, ext, line, cosmetic):
    assert spark.range(1).select(X.is_cosmetic(F.lit(line), F.lit(ext))).first()[0] is cosmetic


def test_folders_and_limits(spark):
    check(spark, lambda c: X.first_folder(c, "src"), {"src/a/b.py": "a", "srcfoo/a.py": "srcfoo", "src/a.py": "<root>", "src": "<root>", "/x/y/": "x", "y": "<root>", "src\\q\\z": "q"})
    check(spark, X.is_rate_limited, {"billing": True, "Try again": True, "RESOURCE_EXHAUSTED": True, "exceeded your quota": True, "quota exceeded": False, "529": False, "rate-limit": True, "fine": False})
