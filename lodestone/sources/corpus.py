"""A data source of source files: dotfiles and names with a leading underscore included, which Spark's own file
sources leave out.

    spark.dataSource.register(CorpusSource)
    spark.read.format("corpus").option("path", root).load()

Options: path (a folder or one file), include and exclude (patterns, comma-separated), dialect (scanner, base or
full), gitignore (true), text_only (true), follow_links (false), max_depth (10), max_files (none), pushdown (false).
Without the content column in use set content=false, and no file is read but for sniffing. The driver lists names; executors
read, in partitions of ``files_per_partition`` files, so the folder must be one that all of them see; sources.listing lists
in tasks.

With pushdown, and Spark's setting spark.sql.python.filterPushdown.enabled, conditions on file, size and last_modified are
decided by the source: folders that hold no wanted file are not entered, and a file that is not wanted is never opened.
max_files is then a limit on the wanted files.
"""

from __future__ import annotations

import datetime
import operator
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from ..operators.globs import scanner_regex, standard_regex

# Extensions of files that are text without a look inside.
TEXT_EXTENSIONS = frozenset(
    "txt md markdown rst asciidoc js jsx ts tsx vue svelte py rb php java c cpp cc cxx h hpp cs go rs swift kt scala clj cljs "
    "html htm xml svg css scss sass less json yaml yml toml ini cfg conf sql sh bash zsh fish ps1 psm1 psd1 dockerfile makefile "
    "cmake gradle r R m mm pl pm lua vim el".split()
)


def is_text(name: str, sample: bytes) -> bool:
    """By extension, else by the first KiB: no NUL, and over 70 % printable ASCII. An empty sample is no text."""
    if name.rsplit(".", 1)[-1].lower() in TEXT_EXTENSIONS:
        return True
    sample = sample[:1024]
    if not sample or b"\0" in sample:
        return False
    return sum(32 <= b <= 126 or b in (9, 10, 13) for b in sample) / len(sample) > 0.7


def gitignore_patterns(root: str) -> list[str]:
    """Lines of each .gitignore from the root upwards, but for the file system's own root; a folder's pattern covers
    what is in it. Negations are not supported."""
    found, folder = [], os.path.abspath(root)
    while folder != os.path.dirname(folder):
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                lines = [x.strip() for x in f]
        except OSError:
            lines = []
        found += [x + "**" if x.endswith("/") else x for x in lines if x and x[0] not in "#!"]
        folder = os.path.dirname(folder)
    return found


class Patterns:
    def __init__(self, patterns: list[str], dialect: str = "scanner"):
        make = scanner_regex if dialect == "scanner" else standard_regex
        self.dialect = dialect
        self.globs = [(re.compile(make(p)), "/" in p) for p in patterns if "*" in p or dialect != "scanner"]
        self.plain = [p for p in patterns if "*" not in p] if dialect == "scanner" else []

    def __bool__(self) -> bool:
        return bool(self.globs or self.plain)

    def match(self, path: str) -> bool:
        base = path.rsplit("/", 1)[-1]
        for regex, slash in self.globs:
            if self.dialect == "scanner" and (regex.search(path) or regex.search(base)):
                return True
            if self.dialect == "base" and regex.search(path if slash else base) or self.dialect == "full" and regex.search(path):
                return True
        return any(path == p or path.startswith(p + "/") or base == p for p in self.plain)


#: What each pushed condition says of a value and the condition's own.
CONDITIONS = {
    EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda v, among: v in among, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda v, part: part in v,
}


class Wanted:
    """Conditions on a file's relative path, size and time, decided before it is opened."""

    COLUMNS = ("file", "size", "last_modified")

    def __init__(self) -> None:
        self.filters: list[Filter] = []

    def take(self, f: Filter) -> bool:
        """Keeps a condition that can be decided here; whether it was one."""
        inner = f.child if isinstance(f, Not) else f
        known = type(inner) in CONDITIONS or isinstance(inner, IsNotNull)
        if known and len(inner.attribute) == 1 and inner.attribute[0] in self.COLUMNS and (isinstance(inner, IsNotNull) or inner.value is not None):
            self.filters.append(f)
            return True
        return False

    def allows(self, column: str, value: object) -> bool:
        for f in self.filters:
            inner = f.child if isinstance(f, Not) else f
            if inner.attribute[0] != column:
                continue
            said = True if isinstance(inner, IsNotNull) else CONDITIONS[type(inner)](value, inner.value)
            if said == isinstance(f, Not):
                return False
        return True

    def enters(self, folder: str) -> bool:
        """Whether a folder may hold a file whose path is allowed."""
        inside = folder + "/"
        for f in self.filters:
            if isinstance(f, EqualTo | EqualNullSafe) and f.attribute[0] == "file" and not f.value.startswith(inside):
                return False
            if isinstance(f, In) and f.attribute[0] == "file" and not any(v.startswith(inside) for v in f.value):
                return False
            if isinstance(f, StringStartsWith) and f.attribute[0] == "file" and not (f.value.startswith(inside) or inside.startswith(f.value)):
                return False
        return True


def scan(root: str, include: list[str] | None = None, exclude: list[str] | None = None, dialect: str = "scanner", gitignore: bool = True, follow_links: bool = False, max_depth: int = 10, text_only: bool = True, only: Wanted | None = None) -> Iterator[str]:
    """Relative paths, in order. Folders that are left out are not entered."""
    only = only or Wanted()
    if os.path.isfile(root):
        if only.allows("file", os.path.basename(root)):
            yield os.path.basename(root)
        return
    wanted = Patterns(include or [], dialect)
    out = Patterns([p for p in exclude or [] if not p.startswith("!")], dialect)
    ignored = Patterns(gitignore_patterns(root) if gitignore else [])

    seen: set[str] = set()

    def walk(folder: str, depth: int) -> Iterator[str]:
        if depth > max_depth:
            return
        if follow_links:  # a link may lead back to a folder above it
            real = os.path.realpath(os.path.join(root, folder))
            if real in seen:
                return
            seen.add(real)
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() and not follow_links or ignored.match(path) or out.match(path):
                continue
            if e.is_dir():
                if only.enters(path):
                    yield from walk(path, depth + 1)
            elif only.allows("file", path) and (not wanted or wanted.match(path)):
                if only.filters:
                    try:
                        stat = e.stat()
                    except OSError:
                        continue
                    if not (only.allows("size", stat.st_size) and only.allows("last_modified", modified(stat))):
                        continue
                if text_only and not is_text(e.name, b""):
                    try:
                        with open(e.path, "rb") as f:
                            if not is_text(e.name, f.read(1024)):
                                continue
                    except OSError:
                        continue
                yield path

    yield from walk("", 0)


def modified(stat: os.stat_result) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = lambda k, d: options.get(k, d)
        yes = lambda k, d: str(get(k, d)).lower() == "true"
        split = lambda k: [p for p in get(k, "").split(",") if p]
        self.root, self.content = options["path"], yes("content", "true")
        self.per = int(get("files_per_partition", 500))
        self.limit = int(options["max_files"]) if "max_files" in options else None
        self.how = {"include": split("include"), "exclude": split("exclude"), "dialect": get("dialect", "scanner"), "gitignore": yes("gitignore", "true"), "follow_links": yes("follow_links", "false"), "max_depth": int(get("max_depth", 10)), "text_only": yes("text_only", "true")}

        self.only = Wanted()

    def partitions(self) -> list[InputPartition]:
        paths = []
        for p in scan(self.root, **self.how, only=self.only):
            if self.limit is not None and len(paths) >= self.limit:
                break
            paths.append(p)
        return [Files(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        base = os.path.dirname(self.root) if os.path.isfile(self.root) else self.root
        for rel in partition.paths:
            full = os.path.join(base, rel)
            try:
                stat = os.stat(full)
                if not (self.only.allows("size", stat.st_size) and self.only.allows("last_modified", modified(stat))):
                    continue
                data = None
                if self.content:
                    with open(full, "rb") as f:
                        data = f.read().decode("utf-8", "replace")
            except OSError:
                continue  # gone since it was listed
            yield full, rel, stat.st_size, modified(stat), data


class PushingReader(CorpusReader):
    """Decides conditions itself. Spark asks for its setting wherever a reader could."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.only.take(f):
                yield f


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, file string, size bigint, last_modified timestamp, content string"

    def reader(self, schema: StructType) -> CorpusReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown", "false").lower() == "true" else CorpusReader)(options)
