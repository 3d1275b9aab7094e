"""Column builders for paths, commit subjects and source lines.

Patterns use ASCII classes and explicit word edges, so that they mean the same in every regex engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that mark a test, as regexes over a normalised path.
TEST_PATTERNS = (
    r"(^|/)tests?/",
    r"(^|/)__tests__/",
    r"(^|/)__mocks__/",
    r"(^|/)test_[^/]+\.py$",
    r"(^|/)[^/]+_test\.(py|go|rs)$",
    r"(^|/)conftest\.py$",
    r"\.(test|spec)\.(ts|tsx|js|jsx|mts|cts)$",
)
# What makes a commit a fix, and what makes it none, in any case.
FIX_PATTERNS = (
    r"\bfix\b",
    r"\bbug\b",
    r"\bpatch\b",
    r"\bresolves?\b",
    r"closes?\s+#\d+",
    r"fixes?\s+#\d+",
)
NOT_FIX_PATTERNS = (
    r"^Merge ",
    r"\btypo\b",
    r"\bbump\b",
    r"\bdeps?\b",
    r"\bchore\b",
    r"\blint\b",
    r"\bformat\b",
    r"\bstyle\b",
    r"\bdocs?\b",
)
# The mark and the beginning that other conventions give a fix.
FIX_EMOJI, FIX_PREFIX = "\U0001f41b", "Fixed #"
# A reference after a closing word, and any reference.
CLOSING_REF = r"\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b[:\s]+#(\d+)"
BARE_REF = r"#(\d+)"
# Parts of an issue label that make it a bug.
BUG_LABELS = ("bug", "defect", "regression")
# What a service says when it is asked too often, in any case.
RATE_LIMIT = (
    r"rate.?limit",
    r"too many requests",
    r"429",
    r"overloaded",
    r"capacity",
    r"usage.?limit",
    r"exceeded.*quota",
    r"throttl",
    r"billing",
    r"try again",
    r"resource_exhausted",
)

# Extensions whose line comments begin with # and with //.
HASH_COMMENTS = (".py",)
SLASH_COMMENTS = (".rs", ".go", ".js", ".jsx", ".ts", ".tsx", ".mts", ".cts", ".java", ".kt", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs")

#: Case is ignored; word edges, digits and white space are Unicode's.
_ANY_CASE = "(?iU)"


def normalise_path(path: Column) -> Column:
    """Forward slashes, none at the ends."""
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def any_pattern(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_test_file(path: Column) -> Column:
    return normalise_path(path).rlike(any_pattern(TEST_PATTERNS))


def should_include(path: Column, lines: Column, floor: int = 10) -> Column:
    return ~is_test_file(path) & (lines >= floor)


def wildcard(rule: str) -> str:
    """A regex over whole paths for one ignore rule: ``*`` and ``?`` stay within a folder, ``**`` does not, a rule with a
    slash in front or inside starts at the top, one with a slash at the end fits folders only."""
    folder = rule.endswith("/")
    body = rule.strip("/")
    top = "/" in rule.rstrip("/")
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/") and (not i or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**" and (not i or body[i - 1] == "/"):
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            inner = rest[1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", i + end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return ("^" if top else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules take a normalised path: the last rule that fits decides, one with ``!`` in front brings it back;
    empty rules and comments are passed over."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        out = F.when(path.rlike(wildcard(rule[1:] if back else rule)), not back).otherwise(out)
    return out


def in_source(path: Column, root: str, extensions: list[str]) -> Column:
    ends = F.lit(False)
    for e in extensions:
        ends = ends | path.endswith(e)
    return path.startswith(root) & ends


def words(terms) -> tuple[str, ...]:
    """Patterns for terms as whole words."""
    return tuple(r"\b" + re.escape(t) + r"\b" for t in terms)


def is_fix(subject: Column, strategy: str = "keyword", include=FIX_PATTERNS, exclude=NOT_FIX_PATTERNS, mark: str | None = None) -> Column:
    """Whether a commit subject tells of a fix.

    ``keyword``: it matches a pattern to include and none to exclude (:func:`words` makes patterns of plain terms);
    ``prefix``: it starts with ``mark``; ``gitmoji``: it contains ``mark``.
    """
    if strategy == "prefix":
        return subject.startswith(mark or FIX_PREFIX)
    if strategy == "gitmoji":
        return subject.contains(mark or FIX_EMOJI)
    return ~subject.rlike(_ANY_CASE + any_pattern(exclude)) & subject.rlike(_ANY_CASE + any_pattern(include))


def issue_refs(subject: Column) -> Column:
    """Issue numbers, those after a closing word first, then all in order, each once; a number beyond a long is left out."""
    closing = F.regexp_extract_all(subject, F.lit(_ANY_CASE + CLOSING_REF), F.lit(1))
    every = F.regexp_extract_all(subject, F.lit(BARE_REF), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(closing, every), lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def is_bug_issue(missing: Column, is_pr: Column, labels: Column) -> Column:
    return ~F.coalesce(missing, F.lit(False)) & ~F.coalesce(is_pr, F.lit(False)) & F.exists(labels, lambda x: F.lower(x).rlike("|".join(BUG_LABELS)))


def extension(path: Column) -> Column:
    """From the last dot of the path, with it; empty without one."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_cosmetic(line: Column, ext: Column) -> Column:
    """Blank, only brackets and separators, a comment line of the language, or a line of a block comment."""
    bare = strip(line)
    comment = ext.isin(*HASH_COMMENTS) & bare.startswith("#") | ext.isin(*SLASH_COMMENTS) & bare.startswith("//")
    block = F.lit(False)
    for start in ("/*", "*", '"""', "'''"):
        block = block | bare.startswith(start)
    return (bare == "") | bare.rlike(r"^[{}()\[\];,]+$") | F.coalesce(comment, F.lit(False)) | block


def fingerprint(line: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def first_folder(path: Column, root: str) -> Column:
    """The first folder below the root, ``<root>`` for a file that lies there.  Other roots' paths keep their own."""
    path, root = normalise_path(path), root.replace("\\", "/").strip("/")
    if root:
        path = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).when(path == root, F.lit("")).otherwise(path)
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("<root>")


def is_rate_limited(message: Column) -> Column:
    return message.rlike("(?i)" + any_pattern(RATE_LIMIT))


def hunk(line: Column) -> Column:
    """``start, lines`` of the old side of a hunk header; an absent count is 1, no header is null."""
    pattern = r"^@@ -([0-9]+)(?:,([0-9]+))? \+[0-9]+(?:,[0-9]+)? @@"
    count = F.coalesce(F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")), F.lit("1")).cast("int")
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).cast("int").alias("start"), count.alias("lines")))


def blame(line: Column) -> Column:
    """``lineno, sha`` of a porcelain blame header."""
    pattern = r"^([0-9a-f]{40}) [0-9]+ ([0-9]+)"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 2).cast("int").alias("lineno"), F.regexp_extract(line, pattern, 1).alias("sha")))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600.0
