from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes as C
from lodestone.operators import diffs, globs
from lodestone.operators import selector as S

CHANGE = "file string, status string, additions int, deletions int, diff string, old_file string, ord int"


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [
        ("**/node_modules/**", "node_modules/a.js", False),
        ("**/node_modules/**", "a/node_modules/b", True),
        ("**/node_modules/**", "a/b/node_modules/c", False),
        ("subdir/**", "subdir/x", True),
        ("subdir/**", "subdir/a/f", False),
        ("*.log", "a/b/c.log", True),
        ("logs", "logs/a.txt", True),
        ("package-lock.json", "x/package-lock.json", True),
    ],
)
def test_scanner_dialect(spark, pattern, path, want):
    assert spark.range(1).select(globs.scanner_match(F.lit(path), pattern)).first()[0] is want


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("**/*.py", "a.py", True), ("**/*.py", "a/b/c.py", True), ("src/**", "src/a/b", True), ("*.{ts,js}", "a.js", True), ("a?.txt", "ab.txt", True), ("[!a]*.py", "b.py", True), ("*.py", "a/b.py", False)],
)
def test_standard_dialect(pattern, path, want):
    assert bool(re.search(globs.standard_regex(pattern), path)) is want


def test_name_globs_and_excludes():
    assert globs.name_matches("UserService", ["User*"]) and not globs.name_matches("AUser", ["User*"])
    assert globs.name_matches("a(b", ["(b"], "syntax")
    assert "*.lock" in globs.default_excludes() and "*.lock" not in globs.default_excludes("lock_files")
    assert "**/*.test.ts" in globs.distill_excludes() and "**/*.test.ts" not in globs.combine_excludes()
    assert globs.wants_tests(["src/**/*.test.ts"]) and not globs.wants_tests(["src/*.ts"])
    with pytest.raises(ValueError, match="not optional"):
        globs.default_excludes("git")


def test_merge_changes(spark):
    staged = spark.createDataFrame([("b", "added", 2, 0, "sb", None, 0), ("a", "renamed", 1, 1, "sa", "z", 1)], CHANGE)
    unstaged = spark.createDataFrame([("c", "modified", 5, 0, "uc", None, 0), ("a", "modified", 3, 2, "ua", None, 1)], CHANGE)
    got = [tuple(r)[:6] for r in C.merge_changes(staged, unstaged).orderBy("ord").collect()]
    assert got == [("b", "added", 2, 0, "sb", None), ("a", "renamed", 4, 3, "sa\nua", "z"), ("c", "modified", 5, 0, "uc", None)]


@pytest.mark.parametrize(
    ("status", "added", "deleted", "lines", "manual", "want"),
    [("added", 49, 0, 49, None, True), ("added", 50, 0, 50, None, False), ("modified", 40, 0, 100, None, False), ("modified", 40, 1, 100, None, True), ("deleted", 0, 9, 3, "*.txt", False), ("renamed", 9, 9, 3, None, False), ("renamed", 0, 0, 3, "*.txt", True)],
)
def test_smart_context(spark, status, added, deleted, lines, manual, want):
    rows = spark.createDataFrame([("d/f.txt", status, added, deleted, "x", None, 0)], CHANGE)
    contents = spark.createDataFrame([("d/f.txt", "\n" * (lines - 1))], "file string, content string")
    assert (C.smart_context(rows, contents, manual).first().full_content is not None) is want
    assert C.smart_context(rows, contents, manual, diff_only=True).first().full_content is None


def test_savings_may_be_negative(spark):
    rows = spark.createDataFrame([("f", "modified", 1, 0, "x" * 100, None, 0)], CHANGE)
    shown = C.smart_context(rows, spark.createDataFrame([("f", "y" * 40)], "file string, content string"), diff_only=True)
    r = C.token_savings(shown, spark.createDataFrame([("f", "y" * 40)], "file string, content string")).first()
    assert (r.full_file_tokens, r.actual_tokens, r.saved, r.percent_saved) == (10, 25, -15, -150)
    empty = C.token_savings(shown.limit(0), spark.createDataFrame([], "file string, content string")).first()
    assert (empty.full_file_tokens, empty.percent_saved) == (0, 0)


def test_parse_diff(spark):
    text = """junk before
diff --git a/x b/y.py b/x b/y.py
index 1..2 100644
--- a/x
+++ b/x
@@ -1,2 +1,2 @@
 same
-old
+new
+++odd
diff --git a/old.txt b/new.txt
similarity index 100%
rename from old.txt
rename to new.txt
diff --git a/n b/n
new file mode 100644
+one
diff --git a/d b/d
deleted file mode 100644
-one
Binary files differ
"""
    got = [tuple(r) for r in diffs.parse_diff(spark.createDataFrame([(text,)], "diff_text string")).orderBy("ord").collect()]
    assert [r[:4] for r in got] == [("y.py", "modified", 1, 1), ("new.txt", "renamed", 0, 0), ("n", "added", 1, 0), ("d", "deleted", 0, 1)]
    assert got[0][4] == "@@ -1,2 +1,2 @@\n same\n-old\n+new" and got[1][5] == "old.txt" and got[0][5] is None
    assert diffs.parse_diff(spark.createDataFrame([("",), (None,)], "diff_text string")).count() == 0


def test_selector(spark):
    import datetime

    d = datetime.datetime
    rows = [("a/x.py", "added", d(2024, 1, 2), 10, 1, True), ("a/y.py", "modified", None, 30, 2, False), ("b.py", "deleted", d(2024, 1, 3), 20, 3, True)]
    df = spark.createDataFrame(rows, "file string, status string, last_modified timestamp, file_size long, ord int, selected boolean")
    names = lambda keys: [r.file for r in df.orderBy(*keys).collect()]
    assert names(S.sort_keys("updated")) == ["a/y.py", "a/x.py", "b.py"]
    assert names(S.panel_sort_keys("updated")) == ["b.py", "a/x.py", "a/y.py"]
    assert names(S.panel_sort_keys("size")) == ["a/y.py", "b.py", "a/x.py"]
    assert {r.directory: (r.files, r.selected, r.mixed) for r in S.header_state(df).collect()} == {"a": (2, False, True), "": (1, True, False)}
    assert [r.file for r in df.where(S.search(F.col("file"), "AX")).collect()] == ["a/x.py"]
    assert [r.file for r in df.where(S.search(F.col("file"), "b.")).collect()] == ["b.py"]
    with pytest.raises(ValueError, match="unknown filter"):
        S.status_filter("odd")
