"""Languages by file extension, as fixed lookup values and as expressions.

The four maps differ on purpose: detection (null if unknown), syntax names (txt if unknown), and the fences of
extracted and of combined files (the extension itself if unknown).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language, for detection.
DETECT = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyw": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "swift": "swift",
    "rb": "ruby", "php": "php", "scala": "scala", "r": "r", "lua": "lua", "dart": "dart", "jl": "julia", "ex": "elixir", "exs": "elixir",
    "clj": "clojure", "cljs": "clojure", "hs": "haskell", "ml": "ocaml", "fs": "fsharp", "nim": "nim", "v": "vlang", "zig": "zig",
    "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish", "ps1": "powershell", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less",
    "sql": "sql", "graphql": "graphql", "gql": "graphql", "md": "markdown", "mdx": "markdown",
}

# Extension to the name used in Markdown fences of distilled files.
SYNTAX = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust",
    "java": "java", "cpp": "cpp", "c": "c", "cs": "csharp", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash",
    "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "sql": "sql", "md": "markdown",
    "mdx": "markdown", "vue": "vue", "svelte": "svelte", "lua": "lua", "dart": "dart", "r": "r", "m": "matlab", "jl": "julia", "nim": "nim",
    "zig": "zig", "ex": "elixir", "exs": "elixir", "clj": "clojure", "cljs": "clojure", "ml": "ocaml", "fs": "fsharp", "fsx": "fsharp",
    "pl": "perl", "pm": "perl", "hs": "haskell", "elm": "elm", "erl": "erlang", "hrl": "erlang",
}

# Extension to the fence of an extracted file.
EXTRACT_FENCE = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java",
    "cpp": "cpp", "c": "c", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash",
    "yml": "yaml", "yaml": "yaml", "json": "json", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "sql": "sql", "md": "markdown",
}

# What the fence of a combined file differs in.
COMBINE_FENCE = {k: v for k, v in EXTRACT_FENCE.items() if k != "scala"} | {"sass": "sass", "less": "less"}


def lookup(values: dict[str, str], key: Column, default: Column | str | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def file_ext(path: Column) -> Column:
    """What follows the last dot; the whole path if there is none."""
    return F.substring_index(path, ".", -1)


def file_ext_or_empty(path: Column) -> Column:
    return F.when(F.instr(path, ".") > 0, file_ext(path)).otherwise("")


def detect_language(path: Column) -> Column:
    return lookup(DETECT, F.lower(file_ext(path)))


def syntax_language(path: Column) -> Column:
    return lookup(SYNTAX, F.lower(file_ext(path)), "txt")


def extract_fence(path: Column) -> Column:
    return lookup(EXTRACT_FENCE, file_ext(path), file_ext(path))


def combine_fence(path: Column) -> Column:
    ext = file_ext_or_empty(path)
    return lookup(COMBINE_FENCE, F.lower(ext), ext)


def supported_languages() -> list[str]:
    return sorted(set(DETECT.values()))


def is_supported(language: str) -> bool:
    return language in DETECT.values()


def extensions_for(language: str) -> list[str]:
    return [ext for ext, name in DETECT.items() if name == language]
