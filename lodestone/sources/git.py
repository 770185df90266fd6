"""Working trees and histories of git as data sources.

    spark.dataSource.register(GitDiffSource)
    spark.read.format("gitdiff").option("repo", root).option("mode", "staged").load()   # a row a changed file: diff_text, at

gitdiff modes: current, staged, since (base), range (from, to), feature (merge base of the main branch). gitfiles
modes: untracked, tracked. gitblob reads HEAD's content of files, else the working tree's. gitmeta is one row of
repository, branch, commit, is_feature_branch, main_branch. The folder must be one that executors see.

The driver asks for names only. Diffs and blobs are read in partitions of ``files_per_partition`` files (200), each by a git
process of its own whose output is taken a file at a time, so a task holds one file's diff or one object.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.diffs import parse_diff

MAIN_LIKE = ("main", "master", "develop", "dev")
MAIN_CANDIDATES = ("main", "master", "develop")


def git(repo: str, *args: str, check: bool = True) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if check and done.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace") if not done.returncode else ""


def is_repository(path: str) -> bool:
    return git(path, "rev-parse", "--is-inside-work-tree", check=False).strip() == "true"


def main_branch(repo: str) -> str | None:
    have = set(git(repo, "branch", "--format=%(refname:short)").split())
    return next((b for b in MAIN_CANDIDATES if b in have), None)


def current_branch(repo: str) -> str:
    return git(repo, "rev-parse", "--abbrev-ref", "HEAD", check=False).strip() or "unknown"


def is_feature_branch(branch: str) -> bool:
    return branch not in MAIN_LIKE


def repository_name(repo: str) -> str:
    remotes = git(repo, "remote", check=False).split()
    url = git(repo, "remote", "get-url", remotes[0], check=False).strip() if remotes else ""
    found = re.search(r"([^/]+)\.git$", url)
    return found[1] if found else os.path.basename(os.path.abspath(repo))


def diff_arguments(repo: str, options: dict[str, str]) -> list[str]:
    mode = options.get("mode", "current")
    if mode == "current":
        return ["diff"]
    if mode == "staged":
        return ["diff", "--cached"]
    if mode == "since":
        return ["diff", f"{options['base']}...HEAD"]
    if mode == "range":
        return ["diff", f"{options['from']}..{options['to']}"]
    if mode == "feature":
        main = options.get("base") or main_branch(repo)
        base = git(repo, "merge-base", main, "HEAD", check=False).strip() if main else ""
        if not base:
            raise ValueError("there is no merge base with a main branch")
        return ["diff", f"{base}...HEAD"]
    raise ValueError(f"unknown mode {mode!r}")


def parse_range(text: str) -> dict[str, str]:
    """a..b, a...b (changes since the merge base) or a single ref."""
    if "..." in text:
        base, _, to = text.partition("...")
        return {"mode": "since", "base": base} if to in ("", "HEAD") else {"mode": "range", "from": base, "to": to}
    if ".." in text:
        base, _, to = text.partition("..")
        return {"mode": "range", "from": base, "to": to or "HEAD"}
    return {"mode": "since", "base": text}


class _OneShot(DataSourceReader):
    def __init__(self, options: dict[str, str], rows):
        self.options, self.rows = options, rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(self.options["repo"], self.options)


def names(repo: str, *args: str) -> Iterator[str]:
    """Names that git parts by NUL, as it prints them."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        rest = b""
        while data := run.stdout.read(1 << 16):
            *whole, rest = (rest + data).split(b"\0")
            yield from (x.decode("utf-8", "surrogateescape") for x in whole if x)
        failure = run.stderr.read().decode(errors="replace").strip()
    if run.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {failure}")


def _files(repo: str, o: dict[str, str]) -> Iterator[tuple]:
    args = ["--others", "--exclude-standard"] if o.get("mode", "untracked") == "untracked" else []
    for k, name in enumerate(names(repo, "ls-files", "-z", *args)):
        yield name.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), k


class Chunk(InputPartition):
    """Groups of names (a file's, or a renamed file's two), from a place on; the command that reads them."""

    def __init__(self, groups: list[list[str]], start: int, command: list[str]):
        super().__init__(start)
        self.groups, self.start, self.command = groups, start, command


class _Chunked(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.repo = options, options["repo"]
        self.per = int(options.get("files_per_partition", 200))

    def chunks(self, groups: Iterator[list[str]], command: list[str]) -> list[InputPartition]:
        every = list(groups)
        return [Chunk(every[i : i + self.per], i, command) for i in range(0, len(every), self.per)] or [Chunk([], 0, command)]


class DiffReader(_Chunked):
    def partitions(self) -> list[InputPartition]:
        command = diff_arguments(self.repo, self.options)

        def changed() -> Iterator[list[str]]:
            found = names(self.repo, *command, "--name-status", "-z")
            for status in found:
                yield [next(found), next(found)] if status[0] in "RC" else [next(found)]

        return self.chunks(changed(), command)

    def read(self, partition: Chunk) -> Iterator[tuple]:
        """A row for each file's diff, as git prints it."""
        if not partition.groups:
            return
        paths = [os.fsencode(x) for group in partition.groups for x in group]
        top = git(self.repo, "rev-parse", "--show-toplevel").rstrip("\n")  # names are relative to it
        with subprocess.Popen(["git", "-C", top, "-c", "core.quotePath=false", "--literal-pathspecs", *partition.command, "--", *paths], stdout=subprocess.PIPE) as run:
            held: list[bytes] = []
            at = partition.start
            for line in run.stdout:
                if line.startswith(b"diff --git ") and held:
                    yield b"".join(held).decode("utf-8", "replace"), at
                    held, at = [], at + 1
                held.append(line)
            if held:
                yield b"".join(held).decode("utf-8", "replace"), at
        if run.returncode:
            raise RuntimeError(f"git {' '.join(partition.command)} failed with {run.returncode}")


class BlobReader(_Chunked):
    def partitions(self) -> list[InputPartition]:
        listed = self.options["files"].split("\n") if "files" in self.options else names(self.repo, "ls-files", "-z")
        return self.chunks(([x] for x in listed), ["cat-file", "--batch"])

    def read(self, partition: Chunk) -> Iterator[tuple]:
        """Asks for an object, takes it, then asks for the next."""
        if not partition.groups:
            return
        with subprocess.Popen(["git", "-C", self.repo, *partition.command], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
            for [name] in partition.groups:
                shown = name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                head = b"missing"
                if "\n" not in name:
                    run.stdin.write(b"HEAD:" + os.fsencode(name) + b"\n")
                    run.stdin.flush()
                    head = run.stdout.readline().rstrip(b"\n")
                if not re.search(rb" \d+$", head):
                    yield shown, self.working(name), False
                else:
                    size = int(head.rsplit(b" ", 1)[1])
                    yield shown, run.stdout.read(size + 1)[:size].decode("utf-8", "replace"), True
            run.stdin.close()

    def working(self, name: str) -> str | None:
        try:
            with open(os.path.join(self.repo, name), "rb") as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None


def _meta(repo: str, o: dict[str, str]) -> Iterator[tuple]:
    branch = current_branch(repo)
    commit = git(repo, "rev-parse", "HEAD", check=False).strip()[:7] or "unknown"
    yield repository_name(repo), branch, commit, is_feature_branch(branch), main_branch(repo)


class _GitSource(DataSource):
    format, fields = "", ""

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return self.fields

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        if self.format in ("gitdiff", "gitblob"):
            return (DiffReader if self.format == "gitdiff" else BlobReader)(options)
        return _OneShot(options, _files if self.format == "gitfiles" else _meta)


class GitDiffSource(_GitSource):
    format, fields = "gitdiff", "diff_text string, at int"


class GitFilesSource(_GitSource):
    format, fields = "gitfiles", "file string, ord int"


class GitBlobSource(_GitSource):
    format, fields = "gitblob", "file string, content string, in_head boolean"


class GitMetaSource(_GitSource):
    format, fields = "gitmeta", "repository string, branch string, commit string, is_feature_branch boolean, main_branch string"


def register(spark: SparkSession) -> None:
    for source in (GitDiffSource, GitFilesSource, GitBlobSource, GitMetaSource):
        spark.dataSource.register(source)


def changes(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """The parsed changes of a diff mode, in git's order."""
    rows = parse_diff(spark.read.format("gitdiff").options(repo=repo, **options).load())
    return rows.withColumn("ord", F.col("at") + F.col("ord")).drop("at")


def has_staged_changes(spark: SparkSession, repo: str) -> bool:
    return not changes(spark, repo, mode="staged").isEmpty()


def has_unstaged_changes(spark: SparkSession, repo: str) -> bool:
    return not changes(spark, repo, mode="current").isEmpty()
