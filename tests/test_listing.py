"""Listing in tasks and conditions that reach the scanner."""

from __future__ import annotations

import builtins
import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringEndsWith, StringStartsWith

from lodestone.plans import distill
from lodestone.sources import corpus, listing


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {
        "a.txt": "a", "a/z.py": "x = 1", "a/b/c.ts": "export const a = 1", "a-b/q.md": "q", ".env": "K=1", "pkg/__init__.py": "", "pkg/data.bin": "\0\1", "pkg/plain": "words here", "pkg/.gitignore": "x", "x.y/deep/er/still/f.txt": "f", ".gitignore": "skipped/\n*.log\n",
        "skipped/a.txt": "s", "b.log": "l", "é/ü.txt": "ü",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (root / "a" / "loop").symlink_to(root)
    (root / "link.txt").symlink_to(root / "a.txt")
    return str(root)


def ordered(df):
    return [r.file for r in df.orderBy(listing.depth_first(F.col("file"))).collect()]


@pytest.mark.parametrize(
    "how",
    [{}, {"text_only": False}, {"gitignore": False}, {"max_depth": 1}, {"max_depth": 0}, {"include": ["*.txt"]}, {"exclude": ["**/*.txt", ".*"], "dialect": "full"}, {"exclude": ["a"]}],
)
def test_same_files_in_the_same_order_as_the_walk(spark, tree, how):
    want = list(corpus.scan(tree, **how))
    assert ordered(listing.listed(spark, tree, **how)) == want
    for n in () if how else (0, 1, 5, len(want), len(want) + 1):
        assert [r.file for r in listing.listed(spark, tree, max_files=n, **how).collect()] == want[:n]


def test_links(spark, tree):
    want = set(corpus.scan(tree, follow_links=True))
    assert set(ordered(listing.listed(spark, tree, follow_links=True))) == want and "link.txt" in want


def test_contents(spark, tree):
    files = listing.listed(spark, tree)
    got = {r.file: (r.content, r.size) for r in listing.contents(files, on_error="drop").collect()}
    plain = {r.file: (r.content, r.size) for r in distill.corpus(spark, tree).collect()}
    assert got == plain
    gone = files.limit(1).withColumn("path", F.lit(tree + "/none"))
    assert listing.contents(gone).first().error.startswith("Failed to read")
    assert listing.contents(gone, on_error="drop").collect() == [] and listing.contents(files.where("false")).collect() == []
    assert ordered(listing.listed(spark, os.path.join(tree, "a.txt"))) == ["a.txt"]


def test_many_files_over_several_tasks(spark, tmp_path):
    for d in range(100):
        folder = tmp_path / f"d{d % 10}" / f"e{d}"
        folder.mkdir(parents=True)
        for k in range(1000):
            os.close(os.open(folder / f"f{k}.txt", os.O_CREAT))
    files = listing.listed(spark, str(tmp_path))
    assert files.count() == 100_000
    assert files.select(F.input_file_name()).distinct().count() > 2
    want = list(corpus.scan(str(tmp_path)))
    assert ordered(files) == want
    assert [r.file for r in listing.listed(spark, str(tmp_path), max_files=1500).collect()] == want[:1500]


# conditions in the source


@pytest.fixture
def pushing(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    yield spark
    spark.conf.unset(key)


def test_conditions_give_what_spark_gives(pushing, tree):
    rows = distill.corpus(pushing, tree)
    everything = {r.file: r for r in rows.collect()}
    assert set(everything) == set(corpus.scan(tree))
    for condition, test in {
        "file LIKE 'a/%'": lambda r: r.file.startswith("a/"), "file LIKE '%.txt'": lambda r: r.file.endswith(".txt"), "file LIKE '%b%'": lambda r: "b" in r.file, "file = 'a/z.py'": lambda r: r.file == "a/z.py",
        "file IN ('a.txt', 'pkg/plain', 'none')": lambda r: r.file in ("a.txt", "pkg/plain"), "NOT file LIKE 'a%'": lambda r: not r.file.startswith("a"), "size > 4 AND file LIKE '%.py'": lambda r: r.size > 4 and r.file.endswith(".py"),
        "last_modified > '2100-01-01'": lambda r: False, "size <= 1": lambda r: r.size <= 1, "upper(file) = 'A.TXT'": lambda r: r.file.upper() == "A.TXT", "content LIKE 'x%'": lambda r: r.content.startswith("x"),
        "file LIKE 'a%' OR size = 0": lambda r: r.file.startswith("a") or r.size == 0, "file IS NOT NULL AND file > 'b'": lambda r: r.file > "b",
    }.items():
        assert {r.file for r in rows.where(condition).collect()} == {f for f, r in everything.items() if test(r)}, condition


def opened(monkeypatch, tree, *filters):
    """The files that listing and reading open, and the folders that listing enters."""
    files, folders = [], []
    real, scandir = builtins.open, os.scandir
    monkeypatch.setattr(builtins, "open", lambda f, *a, **b: (files.append(os.path.relpath(str(f), tree)), real(f, *a, **b))[1])
    monkeypatch.setattr(os, "scandir", lambda d: (folders.append(os.path.relpath(d, tree)), scandir(d))[1])
    reader = corpus.PushingReader({"path": tree, "gitignore": "false"})
    rest = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.undo()
    return files, folders, rest, [r[1] for r in rows]


def test_what_is_not_wanted_is_never_opened(monkeypatch, tree):
    file = ("file",)
    files, folders, rest, rows = opened(monkeypatch, tree, StringStartsWith(file, "pkg/"), IsNotNull(file))
    assert rest == [] and set(folders) == {".", "pkg"} and all(f.startswith("pkg/") for f in files) and "pkg/plain" in rows
    files, folders, _, rows = opened(monkeypatch, tree, StringEndsWith(file, ".ts"))
    assert files == ["a/b/c.ts"] == rows
    files, folders, _, rows = opened(monkeypatch, tree, In(file, ("a/b/c.ts", "a.txt")))
    assert set(files) == {"a/b/c.ts", "a.txt"} and set(folders) == {".", "a", "a/b"}
    files, _, rest, rows = opened(monkeypatch, tree, GreaterThan(("size",), 10_000), Not(EqualTo(file, "a.txt")))
    assert files == [] == rows == rest
    files, _, rest, _ = opened(monkeypatch, tree, GreaterThan(("last_modified",), datetime.datetime(2100, 1, 1, tzinfo=datetime.UTC)), EqualTo(("content",), "a"))
    assert files == [] and len(rest) == 1
