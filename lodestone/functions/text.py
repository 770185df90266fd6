"""Scalar functions on texts, sizes, tokens and times. All are built-in expressions; one decimal is rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import file_ext


def line_count(text: Column) -> Column:
    """Parts between line feeds: an empty text has one line, a final line feed one more."""
    return F.size(F.split(text, "\n")).cast("long")


def added_diff(text: Column) -> Column:
    return F.concat(F.lit("+"), F.replace(text, F.lit("\n"), F.lit("\n+")))


def format_diff(diff: Column) -> Column:
    """A space after each leading + or -, two before any other line."""
    line = lambda x: F.when(x.startswith("+") | x.startswith("-"), F.concat(F.left(x, F.lit(1)), F.lit(" "), F.substr(x, F.lit(2)))).otherwise(F.concat(F.lit("  "), x))
    return F.array_join(F.transform(F.split(diff, "\n"), line), "\n")


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def clean_path(path: Column) -> Column:
    """Without one leading src/, else ./, else /."""
    return F.when(path.startswith("src/"), F.substr(path, F.lit(5))).when(path.startswith("./"), F.substr(path, F.lit(3))).when(path.startswith("/"), F.substr(path, F.lit(2))).otherwise(path)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitize_context(context: Column) -> Column:
    """A context as part of a file name."""
    steps = (("[/\\\\]", "."), ('[<>:"|?*]', ""), ("\\s+", "-"), ("\\.{2,}", "."), ("-{2,}", "-"), ("^[.-]+|[.-]+$", ""))
    for pattern, by in steps:
        context = F.regexp_replace(context, pattern, by)
    context = F.lower(context)
    return F.when(context == "", "output").otherwise(context)


def output_name(tool: str, command: str, context: Column, fmt: str) -> Column:
    return F.concat(F.lit(f"{tool}.{command}."), sanitize_context(context), F.lit(f".{fmt}"))


def indent_level(line: Column) -> Column:
    """A space counts one, a tab four."""
    return F.length(F.replace(F.regexp_extract(line, "^[ \\t]*", 0), F.lit("\t"), F.lit("    ")))


def clean_parameters(parameters: Column) -> Column:
    kept = F.filter(F.transform(F.split(parameters, ","), lambda x: F.trim(x)), lambda x: ~x.startswith("self"))
    return F.array_join(kept, ", ")


def preview(doc: Column, length: int) -> Column:
    return F.concat(F.left(doc, F.lit(length)), F.when(F.length(doc) > length, "...").otherwise(""))


def js_round(x: Column) -> Column:
    """Half goes up, towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def change_percent(additions: Column, deletions: Column, lines: Column) -> Column:
    return (additions + deletions) * 100 / lines


def token_multiplier(path: Column) -> Column:
    """Characters a token, by kind of file."""
    name, ext = F.lower(basename(path)), F.lower(F.when(F.instr(basename(path), ".") > 1, file_ext(basename(path))).otherwise(""))
    # Fixed values of the heuristic.
    return (
        F.when(name.contains(".min.") & ext.isin("js", "css"), 2.5)
        .when(ext.isin("js", "ts", "jsx", "tsx", "py", "java", "cpp", "c", "cs", "go", "rs", "php", "rb"), 3.5)
        .when(ext.isin("html", "xml", "json", "yaml", "yml", "toml"), 4.5)
        .when(ext.isin("md", "txt", "rst"), 5.0)
        .otherwise(4.0)
    )


def file_tokens(path: Column, size: Column, additions: Column, deletions: Column) -> Column:
    """Of a changed file 80 characters a changed line; else by its size, an unreadable file (null size) as 1000."""
    changed = additions + deletions
    by_size = F.ceil(F.coalesce(size, F.lit(1000)) / token_multiplier(path))
    return F.when(changed > 0, F.ceil(changed * 80 / 4)).otherwise(by_size).cast("long")


def format_token_count(n: Column) -> Column:
    thousands = n / 1000
    return F.when(n >= 10000, F.format_string("%dk tokens", js_round(thousands))).when(n >= 1000, F.format_string("%.1fk tokens", thousands)).otherwise(F.format_string("%d tokens", n))


def format_token_count_rounded(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%dk tokens", js_round(n / 1000))).otherwise(F.format_string("%d tokens", n))


def format_token_count_short(n: Column, suffix: str = "k") -> Column:
    return F.when(n >= 1000, F.format_string(f"%.1f{suffix}", n / 1000)).otherwise(n.cast("string"))


def token_savings(full: Column, actual: Column) -> Column:
    saved = full - actual
    return F.struct(saved.alias("saved"), F.when(full > 0, saved * 100 / full).otherwise(0.0).alias("percent"))


def _scaled(size: Column, units: list[str]) -> tuple[Column, Column]:
    value, unit = size.cast("double"), F.lit(units[0])
    for k in range(1, len(units)):
        big = size >= 1024**k
        value, unit = F.when(big, size / float(1024**k)).otherwise(value), F.when(big, units[k]).otherwise(unit)
    return value, unit


UNITS = ["B", "KB", "MB", "GB"]


def format_file_size(size: Column) -> Column:
    """Always one decimal."""
    value, unit = _scaled(size, UNITS)
    return F.format_string("%.1f %s", value, unit)


def format_file_size_trimmed(size: Column, gap: str = " ") -> Column:
    """One decimal, but none that is zero."""
    value, unit = _scaled(size, UNITS)
    return F.concat(F.regexp_replace(F.format_string("%.1f", value), r"\.0$", ""), F.lit(gap), unit)


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    ago = lambda n, unit: F.format_string(f"%d{unit} ago", F.floor(s / n).cast("long"))
    return F.when(s >= 86400, ago(86400, "d")).when(s >= 3600, ago(3600, "h")).when(s >= 60, ago(60, "m")).otherwise("just now")


def relative_time_or_date(then: Column, now: Column) -> Column:
    old = F.unix_timestamp(now) - F.unix_timestamp(then) > 7 * 86400
    return F.when(old, F.date_format(then, "M/d/yyyy")).otherwise(relative_time(then, now))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def progress_bar(done: Column, total: Column, width: int = 10) -> Column:
    full = F.least(F.lit(width), F.floor(done * width / F.greatest(total, F.lit(1)))).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def truncate_path(path: Column, length: int) -> Column:
    """The base name, with as many of its parents as fit; a cut path begins with .../"""
    parts = F.reverse(F.split(path, "/"))
    start = F.get(parts, 0)
    grown = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(start.alias("s"), F.lit(True).alias("go")), lambda a, p: F.when(a["go"] & (F.length(a["s"]) + F.length(p) + 5 <= length), F.struct(F.concat(p, F.lit("/"), a["s"]).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("go"))), lambda a: a["s"])
    return F.when(F.length(path) <= length, path).otherwise(F.concat(F.lit(".../"), grown))


def looks_like_text(name: Column, data: Column, extensions: list[str]) -> Column:
    """The scanner's sniff on contents in a table: by extension, else by the first KiB of data (binary): no NUL, and over 70 %
    printable ASCII. Empty data is no text."""
    first = F.substring(data, 1, 1024)
    each = F.decode(first, "ISO-8859-1")  # a character for each byte
    printable = F.length(F.regexp_replace(each, "[^ -~\\t\\n\\r]", ""))
    by_bytes = (F.octet_length(first) > 0) & (F.instr(each, "\0") == 0) & (printable / F.octet_length(first) > 0.7)
    return F.lower(file_ext(name)).isin(*[e.lower() for e in extensions]) | F.coalesce(by_bytes, F.lit(False))


def fingerprint(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(8))


def locale_key(text: Column) -> Column:
    """Sorts as people sort names: letters before case and accents, by the root collation; equal ones need a key more."""
    return F.collate(text, "UNICODE")
