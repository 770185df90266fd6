"""Glob dialects as regular expressions that Java and RE2 read alike, and what is left out by default."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns left out by default, by category.
EXCLUDES = {
    "git": ["**/.git/**"],
    "dependencies": ["**/node_modules/**", "**/vendor/**", "**/bower_components/**"],
    "build": ["**/dist/**", "**/build/**", "**/out/**", "**/.next/**", "**/.nuxt/**"],
    "testing": ["**/coverage/**", "**/.nyc_output/**"],
    "logs": ["*.log", "logs/**", "*.tmp", "tmp/**", "temp/**"],
    "system": [".DS_Store", "thumbs.db", "desktop.ini"],
    "env": [".env*", "!.env.example"],
    "tool": ["**/.lodestone/**", "**/.opencode/**", "**/.workarea/**"],
    "python": ["**/__pycache__/**", "**/.pytest_cache/**", "**/.mypy_cache/**", "*.pyc", "*.pyo"],
    "java": ["**/target/**", "*.class", "**/.gradle/**", "**/gradle/**"],
    "dotnet": ["**/bin/**", "**/obj/**", "*.dll", "*.exe", "*.pdb"],
    "rust": ["**/target/**", "*.rlib"],
    "go": ["*.test", "*.out"],
    "cache": ["**/.cache/**", "**/.parcel-cache/**", "**/.turbo/**", "**/.nx/**"],
    "ide": ["**/.idea/**", "**/.vscode/**", "*.swp", "*.swo", "*~", ".project", ".classpath"],
    "documents": ["*.pdf", "*.doc", "*.docx", "*.xls", "*.xlsx", "*.ppt", "*.pptx"],
    "archives": ["*.zip", "*.tar", "*.gz", "*.rar", "*.7z", "*.bz2", "*.xz", "*.jar", "*.war"],
    "binaries": ["*.exe", "*.dll", "*.so", "*.dylib", "*.lib", "*.a", "*.o", "*.obj", "*.class", "*.pyc", "*.pyo", "*.beam", "*.elc", "*.wasm"],
    "images": ["*.jpg", "*.jpeg", "*.png", "*.gif", "*.ico", "*.svg", "*.bmp", "*.tiff", "*.webp", "*.avif", "*.heic", "*.heif"],
    "media": ["*.mp3", "*.mp4", "*.avi", "*.mov", "*.wmv", "*.flv", "*.webm", "*.mkv", "*.wav", "*.flac", "*.aac", "*.ogg", "*.m4a", "*.m4v", "*.mpg", "*.mpeg"],
    "test_files": ["**/*.spec.ts", "**/*.spec.js", "**/*.test.ts", "**/*.test.js", "**/*.test.tsx", "**/*.test.jsx"],
    "minified": ["*.min.js", "*.min.css"],
    "lock_files": ["*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"],
    "source_maps": ["*.map"],
}
#: Categories that a caller may let in.
OPTIONAL = ("binaries", "images", "media", "test_files", "minified", "lock_files", "source_maps")


def default_excludes(*included: str) -> list[str]:
    """All patterns but those of the included optional categories."""
    if unknown := set(included) - set(OPTIONAL):
        raise ValueError(f"not optional: {sorted(unknown)}")
    return [p for k, patterns in EXCLUDES.items() if k not in included for p in patterns]


def distill_excludes(include_tests: bool = False) -> list[str]:
    return default_excludes(*(["test_files"] if include_tests else []))


def combine_excludes() -> list[str]:
    return default_excludes("test_files")


def wants_tests(include: list[str]) -> bool:
    """Whether an include pattern speaks of tests, which lets tests in."""
    return any(re.search(r"\.(test|spec)\.|(^|/)(tests?|__tests__)(/|$)", p) for p in include)


def escaped(text: str) -> str:
    return re.sub(r"([.^$+?()\[\]{}|\\*])", r"\\\1", text)


def scanner_regex(pattern: str) -> str:
    """The scanner's dialect: ** is written .* first, whose star the rule for * then turns into a run without
    slashes; so ** stands for one character and such a run. Only dots are escaped."""
    return "^" + pattern.replace(".", "\\.").replace("**", ".*").replace("*", "[^/]*") + "$"


def scanner_match(path: Column, pattern: str) -> Column:
    base = F.substring_index(path, "/", -1)
    if "*" in pattern:
        regex = scanner_regex(pattern)
        return path.rlike(regex) | base.rlike(regex)
    return (path == pattern) | path.startswith(pattern + "/") | (base == pattern)


def standard_regex(pattern: str, dot: bool = True) -> str:
    """Usual globs: ** over directories, * and ? within one, [..] classes, {a,b} choices."""
    out, i, n = "^", 0, len(pattern)
    hidden = "" if dot else "(?!\\.)"
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + (hidden if i == 0 or pattern[i - 1] == "/" else "") + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(escaped(x).replace("\\*", "[^/]*") for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + escaped(c), i + 1
    return out + "$"


def base_match(path: Column, pattern: str) -> Column:
    """Dialect of path filters: a pattern without a slash is held against the base name."""
    target = path if "/" in pattern else F.substring_index(path, "/", -1)
    return target.rlike(standard_regex(pattern))


def full_match(path: Column, pattern: str) -> Column:
    """Dialect of the distiller: the whole relative path, dotfiles included."""
    return path.rlike(standard_regex(pattern))


MATCH = {"scanner": scanner_match, "base": base_match, "full": full_match}


def any_match(path: Column, patterns: list[str], dialect: str = "scanner") -> Column:
    return reduce(or_, [MATCH[dialect](path, p) for p in patterns], F.lit(False))


def path_filter(path: Column, include: list[str], exclude: list[str], dialect: str = "scanner") -> Column:
    kept = any_match(path, include, dialect) if include else F.lit(True)
    return kept & ~any_match(path, [p for p in exclude if not p.startswith("!")], dialect)


def ends_with_types(path: Column, types: list[str]) -> Column:
    return reduce(or_, [path.endswith("." + t) for t in types], F.lit(False)) if types else F.lit(True)


#: Name globs by the characters that they escape; an unusable pattern is a substring.
NAME_ESCAPES = {"python": "^+${}()|[]\\", "typescript": "^+${}()|[]\\.", "syntax": ""}


def name_regex(pattern: str, dialect: str = "python") -> str:
    out = "".join(f"\\{c}" if c in NAME_ESCAPES[dialect] else ".*" if c == "*" else "." if c == "?" else c for c in pattern)
    try:
        re.compile(out)
    except re.error:
        return ".*" + re.escape(pattern) + ".*"
    return f"^{out}$"


def name_matches(name: str, patterns: list[str], dialect: str = "python") -> bool:
    return any(re.match(name_regex(p, dialect), name) for p in patterns)
