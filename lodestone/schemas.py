"""Relations as Spark schemas, and the options of the commands."""

from __future__ import annotations

from dataclasses import dataclass, field

FILES = "path string, relative_path string, size bigint, last_modified timestamp, is_directory boolean"
CHANGES = "file string, status string, additions int, deletions int, diff string, old_file string, last_modified timestamp, content string, ord int"
MEMBER = "struct<name:string,signature:string,type:string>"
SYMBOLS = f"file string, ord int, name string, type string, signature string, docstring string, visibility string, start_line int, end_line int, members array<{MEMBER}>"
IMPORTS = "file string, ord int, source string, specifiers array<struct<name:string>>, line int"
SKIPPED = "file string, name string, reason string, line int"
ERRORS = "file string, message string, line int, severity string"

STATUSES = ("added", "modified", "deleted", "renamed")
FORMATS = ("txt", "md", "json")


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return fmt


def check_order(sort_by: str | None, sort_order: str, filter_by: str = "all") -> None:
    if sort_by not in (None, "name", "updated", "size", "status"):
        raise ValueError(f"unknown order {sort_by!r}")
    if sort_order not in ("asc", "desc"):
        raise ValueError(f"unknown direction {sort_order!r}")
    if filter_by not in ("all", "staged", "unstaged", "untracked", *STATUSES[:3]):
        raise ValueError(f"unknown filter {filter_by!r}")


@dataclass
class Metadata:
    """What an extract says about itself; the estimated tokens are added from its rows."""

    generated: str
    repository: str
    branch: str
    commit: str
    method: str
    path: str | None = None
    types: list[str] = field(default_factory=list)
    tool: str = "lodestone"
    version: str = "0.2.0"


@dataclass
class ExtractOptions:
    range: str | None = None
    staged: bool = False
    all: bool = False
    full: str | None = None
    diff_only: bool = False
    path: str | None = None
    types: list[str] = field(default_factory=list)
    format: str = "txt"
    include_untracked: bool = False
    untracked_pattern: str | None = None
    selected_files: list[str] = field(default_factory=list)
    no_metadata: bool = False
    sort_by: str | None = None
    sort_order: str = "asc"
    filter_by: str = "all"

    def __post_init__(self) -> None:
        check_format(self.format)
        check_order(self.sort_by, self.sort_order, self.filter_by)
        if self.staged and self.all:
            raise ValueError("staged and all exclude each other")


@dataclass
class DistillOptions:
    docstrings: bool = True
    private: bool = False
    protected: bool = True
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include_names: list[str] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=list)
    format: str = "txt"
    compat: bool = False
    """Drop docstrings from the symbols, as the distiller that this one follows does."""
    types: str = "declared"
    """TypeScript: ``declared`` types and those of literals, the declarations as ``written``, nested ones included, or
    ``inferred`` ones, over all files together."""
    output: str | None = None

    def __post_init__(self) -> None:
        check_format(self.format)
        if self.types not in ("declared", "written", "inferred"):
            raise ValueError(f"unknown types {self.types!r}")


@dataclass
class CombineOptions:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    max_files: int = 1000
    max_depth: int = 10
    no_gitignore: bool = False
    format: str = "txt"
    output: str | None = None
    sort_by: str | None = None
    sort_order: str = "asc"

    def __post_init__(self) -> None:
        check_format(self.format)
        check_order(self.sort_by, self.sort_order)


@dataclass
class TreeOptions:
    group_by: str = "file"
    include_private: bool = False
    show_types: bool = False
    outline: bool = False
    exclude: list[str] = field(default_factory=list)
    output: str | None = None

    def __post_init__(self) -> None:
        if self.group_by not in ("file", "type", "none"):
            raise ValueError(f"unknown group_by {self.group_by!r}")
