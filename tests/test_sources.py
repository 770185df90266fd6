"""Sources over trees and repositories that the tests make."""

from __future__ import annotations

import os
import subprocess

import pytest

from lodestone.operators import changes as C
from lodestone.plans import combine, distill
from lodestone.schemas import CombineOptions, ExtractOptions
from lodestone.sources import git
from lodestone.sources.corpus import is_text


@pytest.fixture
def tree(tmp_path):
    files = {"a.txt": "one\ntwo", "pkg/__init__.py": "X = 1\n", ".env": "S=1", "deep/er/b.txt": "b", "bin.dat": "a\0b", "empty": "", "skip/me.txt": "s", ".gitignore": "skip/\n# c\n\n*.tmp\n", "c.tmp": "t", "noext": "plain words"}
    for name, content in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    return str(tmp_path)


def names(df):
    return sorted(r.file for r in df.collect())


def test_scan(spark, tree):
    everything = distill.corpus(spark, tree)
    assert names(everything) == [".env", ".gitignore", "a.txt", "deep/er/b.txt", "noext", "pkg/__init__.py"]
    row = everything.where("file = 'a.txt'").first()
    assert row.content == "one\ntwo" and row.size == 7 and row.last_modified is not None
    assert names(distill.corpus(spark, tree, include="*.txt")) == ["a.txt", "deep/er/b.txt"]
    assert names(distill.corpus(spark, tree, exclude="**/*.txt,.*", dialect="full")) == ["noext", "pkg/__init__.py"]
    assert names(distill.corpus(spark, tree, text_only="false", gitignore="false", max_files="3")) == [".env", ".gitignore", "a.txt"]
    assert names(distill.corpus(spark, tree, max_depth="0", content="false")) == [".env", ".gitignore", "a.txt", "noext"]
    assert names(distill.corpus(spark, os.path.join(tree, "a.txt"))) == ["a.txt"]
    assert names(distill.corpus(spark, os.path.join(tree, "none"))) == []


def test_is_text():
    assert is_text("a.PY", b"\0") and not is_text("a", b"") and not is_text("a", b"\xff" * 9 + b"a") and is_text("a", b"abc\n")


def test_combine_corpus(spark, tree):
    files = distill.corpus(spark, tree).select("file", "content")
    doc = combine.combine(files, CombineOptions(include=["*.txt"], exclude=["deep"], max_files=1)).first().document
    assert doc == '<code_context>\n\n<file path="a.txt">\none\ntwo\n</file>\n\n</code_context>'


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    (tmp_path / "b.txt").write_text("b\n")
    run("add", ".")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "feature/x")
    (tmp_path / "c.txt").write_text("c\nd\n")
    run("add", ".")
    run("commit", "-qm", "two")
    (tmp_path / "a.txt").write_text("1\nTWO\n3\n")
    run("add", "a.txt")
    (tmp_path / "a.txt").write_text("1\nTWO\n3\n4\n")
    (tmp_path / "new.txt").write_text("n\n")
    return str(tmp_path)


def test_git(spark, repo):
    git.register(spark)
    rows = lambda **o: sorted((r.file, r.status, r.additions, r.deletions) for r in git.changes(spark, repo, **o).collect())
    assert rows(mode="staged") == [("a.txt", "modified", 1, 1)]
    assert rows(mode="current") == [("a.txt", "modified", 1, 0)]
    assert rows(mode="feature") == rows(mode="since", base="main") == rows(mode="range", **{"from": "main", "to": "HEAD"}) == [("c.txt", "added", 2, 0)]
    numstat = subprocess.run(["git", "-C", repo, "diff", "--numstat", "main..HEAD"], capture_output=True, text=True, check=True).stdout
    assert numstat.split() == ["2", "0", "c.txt"]
    merged = C.merge_changes(git.changes(spark, repo, mode="staged"), git.changes(spark, repo, mode="current")).first()
    assert (merged.additions, merged.deletions) == (2, 1)
    assert [r.file for r in spark.read.format("gitfiles").option("repo", repo).load().collect()] == ["new.txt"]
    meta = spark.read.format("gitmeta").option("repo", repo).load().first()
    assert (meta.branch, meta.is_feature_branch, meta.main_branch, len(meta.commit)) == ("feature/x", True, "main", 7)
    blobs = {r.file: (r.content, r.in_head) for r in spark.read.format("gitblob").options(repo=repo, files="a.txt\nnew.txt\ngone").load().collect()}
    assert blobs == {"a.txt": ("1\n2\n3\n", True), "new.txt": ("n\n", False), "gone": (None, False)}
    assert git.has_staged_changes(spark, repo) and git.has_unstaged_changes(spark, repo)
    assert git.is_repository(repo)


def test_extract_repository(spark, repo):
    doc = combine.extract_repository(spark, repo, ExtractOptions(staged=True, format="md", include_untracked=True)).first().document
    assert "- **Files Changed:** 2" in doc and "### a.txt" in doc and "### new.txt" in doc
    assert "c.txt" in combine.extract_repository(spark, repo, ExtractOptions()).first().document
    path = combine.save(combine.extract_repository(spark, repo, ExtractOptions(range="main")), repo, "extract", "Main..HEAD", "txt")
    assert path.endswith(".lodestone/lodestone.extract.main.head.txt") and "<path>c.txt</path>" in open(path).read()


@pytest.mark.parametrize(("text", "want"), [("a..b", {"mode": "range", "from": "a", "to": "b"}), ("a...HEAD", {"mode": "since", "base": "a"}), ("a...b", {"mode": "range", "from": "a", "to": "b"}), ("a", {"mode": "since", "base": "a"})])
def test_ranges(text, want):
    assert git.parse_range(text) == want
