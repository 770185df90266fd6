from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import languages as L
from lodestone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (lambda: T.line_count(F.lit("")), 1),
        (lambda: T.line_count(F.lit("a\nb\n")), 3),
        (lambda: T.added_diff(F.lit("a\nb")), "+a\n+b"),
        (lambda: T.format_diff(F.lit("+a\n-b\n c\n@@ x")), "+ a\n- b\n   c\n  @@ x"),
        (lambda: T.escape_xml(F.lit("<a b='c'>&\"")), "&lt;a b=&apos;c&apos;&gt;&amp;&quot;"),
        (lambda: T.clean_path(F.lit("src/src/a")), "src/a"),
        (lambda: T.clean_path(F.lit("./a")), "a"),
        (lambda: T.clean_path(F.lit("/a")), "a"),
        (lambda: T.directory(F.lit("a/b/c.txt")), "a/b"),
        (lambda: T.directory(F.lit("c.txt")), ""),
        (lambda: T.sanitize_context(F.lit("Feature/My <New> Thing..")), "feature.my-new-thing"),
        (lambda: T.sanitize_context(F.lit("??")), "output"),
        (lambda: T.output_name("tool", "extract", F.lit("a..b"), "txt"), "tool.extract.a.b.txt"),
        (lambda: T.indent_level(F.lit("\t  x y")), 6),
        (lambda: T.clean_parameters(F.lit("self, a, b=1")), "a, b=1"),
        (lambda: T.preview(F.lit("abcdef"), 3), "abc..."),
        (lambda: T.preview(F.lit("abc"), 3), "abc"),
        (lambda: T.js_round(F.lit(-2.5)), -2),
        (lambda: T.js_round(F.lit(2.5)), 3),
        (lambda: T.estimate_tokens(F.lit("abcde")), 2),
        (lambda: T.token_multiplier(F.lit("a/b.min.js")), 2.5),
        (lambda: T.token_multiplier(F.lit("b.PY")), 3.5),
        (lambda: T.token_multiplier(F.lit("Makefile")), 4.0),
        (lambda: T.file_tokens(F.lit("a.py"), F.lit(None).cast("long"), F.lit(0), F.lit(0)), 286),
        (lambda: T.file_tokens(F.lit("a.py"), F.lit(7), F.lit(2), F.lit(1)), 60),
        (lambda: T.format_token_count(F.lit(999)), "999 tokens"),
        (lambda: T.format_token_count(F.lit(1234)), "1.2k tokens"),
        (lambda: T.format_token_count(F.lit(12500)), "13k tokens"),
        (lambda: T.format_file_size(F.lit(0)), "0.0 B"),
        (lambda: T.format_file_size_trimmed(F.lit(2048)), "2 KB"),
        (lambda: T.format_file_size_trimmed(F.lit(2148), ""), "2.1KB"),
        (lambda: T.progress_bar(F.lit(5), F.lit(10)), "█████░░░░░"),
        (lambda: T.truncate_path(F.lit("aaaa/bbbb/cccc/d.txt"), 16), ".../cccc/d.txt"),
        (lambda: T.truncate_path(F.lit("a/d.txt"), 16), "a/d.txt"),
        (lambda: T.fingerprint(F.lit("abc")), "ba7816bf"),
        (lambda: L.detect_language(F.lit("x/y.TSX")), "typescript"),
        (lambda: L.detect_language(F.lit("x/y.zzz")), None),
        (lambda: L.syntax_language(F.lit("y.zzz")), "txt"),
        (lambda: L.extract_fence(F.lit("y.zzz")), "zzz"),
        (lambda: L.combine_fence(F.lit("Makefile")), ""),
    ],
)
def test_scalar(spark, expression, want):
    assert one(spark, expression()) == want


def test_relative_time(spark):
    now = F.lit(datetime.datetime(2024, 5, 20, 12))
    ages = [30, 90, 3700, 90000, 10 * 86400]
    got = [one(spark, T.relative_time_or_date(F.timestamp_seconds(F.unix_timestamp(now) - a), now)) for a in ages]
    assert got == ["just now", "1m ago", "1h ago", "1d ago", "5/10/2024"]


def test_languages():
    assert L.is_supported("rust") and not L.is_supported("cobol")
    assert L.extensions_for("python") == ["py", "pyw"]
    assert L.supported_languages() == sorted(set(L.supported_languages()))
