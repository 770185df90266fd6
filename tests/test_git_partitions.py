"""Diffs and blobs of a repository over several partitions."""

from __future__ import annotations

import os
import subprocess
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lodestone.operators.diffs import parse_diff
from lodestone.sources import git


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-b", "main")
    (root / "sub").mkdir()
    for k in range(60):
        (root / "sub" / f"f{k:02}.txt").write_text("".join(f"line {k} {i}\n" for i in range(30)))
    (root / "a b é.txt").write_text("spaced\n")
    (root / "star*.txt").write_text("star\n")
    (root / "big.bin").write_bytes(b"x" * 3_000_000)
    run(root, "add", "-A")
    run(root, "commit", "-m", "one")
    for k in range(0, 60, 2):
        (root / "sub" / f"f{k:02}.txt").write_text("".join(f"line {k} {i}\n" for i in range(29)) + "diff --git a/x b/x\nchanged\n")
    os.rename(root / "sub" / "f01.txt", root / "moved.txt")
    os.remove(root / "sub" / "f03.txt")
    (root / "a b é.txt").write_text("spaced out\n")
    (root / "star*.txt").write_text("stars\n")
    (root / "new.txt").write_text("new\n")
    run(root, "add", "-A")
    (root / "loose.txt").write_text("loose\n")
    git.register(spark)
    return str(root)


@pytest.mark.parametrize("per", ["1", "7", "200"])
def test_diffs_are_the_whole_diffs_parts(spark, repo, per):
    load = spark.read.format("gitdiff").options(repo=repo, mode="staged", files_per_partition=per).load()
    rows = load.orderBy("at").collect()
    whole = git.git(repo, "-c", "core.quotePath=false", "diff", "--cached")
    assert "".join(r.diff_text for r in rows) == whole and [r.at for r in rows] == list(range(len(rows))) and len(rows) == 35
    got = git.changes(spark, repo, mode="staged", files_per_partition=per)
    want = parse_diff(spark.createDataFrame([(whole,)], "diff_text string"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    if per == "7":
        assert load.select(F.spark_partition_id()).distinct().count() == 5


def test_blobs_over_several_partitions(spark, repo):
    load = spark.read.format("gitblob").options(repo=repo, files_per_partition="10").load()
    got = {r.file: (r.content, r.in_head) for r in load.collect()}
    names = git.git(repo, "ls-files", "-z").split("\0")[:-1]
    assert set(got) == set(names) and load.select(F.spark_partition_id()).distinct().count() == 7
    for n in names:
        old = git.git(repo, "show", f"HEAD:{n}", check=False)
        assert got[n] == ((old, True) if n not in ("moved.txt", "new.txt") else (open(os.path.join(repo, n)).read(), False)), n
    asked = spark.read.format("gitblob").options(repo=repo, files="loose.txt\nnone\nsub/f05.txt", files_per_partition="1").load().collect()
    assert {r.file: (r.content or "")[:6] for r in asked} == {"loose.txt": "loose\n", "none": "", "sub/f05.txt": "line 5"}


def test_a_task_holds_one_object(repo):
    reader = git.BlobReader({"repo": repo, "files": "\n".join(["big.bin"] * 20)})
    tracemalloc.start()
    assert sum(len(content) for part in reader.partitions() for _, content, _ in reader.read(part)) == 60_000_000
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_diffs_seen_from_a_folder_below(spark, repo):
    below = os.path.join(repo, "sub")
    assert git.changes(spark, below, mode="staged").count() == git.changes(spark, repo, mode="staged").count() == 35


def test_nothing_changed_and_unknown_refs(spark, repo):
    assert git.changes(spark, repo, mode="range", **{"from": "HEAD", "to": "HEAD"}).collect() == []
    with pytest.raises(Exception, match="git diff"):
        git.changes(spark, repo, mode="since", base="nowhere").collect()
