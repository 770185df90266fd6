"""Unified diffs as rows, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_diff(diffs: DataFrame, text: str = "diff_text") -> DataFrame:
    """One row a file of each diff text: file, status, additions, deletions, diff, old_file, ord, with the other
    columns of ``diffs`` before them. A part without a header line is no file."""
    others = [c for c in diffs.columns if c != text]
    parts = diffs.select(*others, F.posexplode(F.split(F.coalesce(text, F.lit("")), "(?m)^diff --git ")).alias("ord", "_part"))
    lines = F.split("_part", "\n")
    head = F.get(lines, 0)
    has = lambda prefix: F.exists(F.col("_lines"), lambda x: x.startswith(prefix))
    plus = lambda x: x.startswith("+") & ~x.startswith("+++")
    minus = lambda x: x.startswith("-") & ~x.startswith("---")
    status = F.when(has("new file mode"), "added").when(has("deleted file mode"), "deleted").when(has("rename from"), "renamed").otherwise("modified")
    kept = F.filter(F.col("_lines"), lambda x: plus(x) | minus(x) | x.startswith("@@") | x.startswith(" "))
    pattern = "^a/(.*) b/(.*)$"
    return (
        parts.where(head.rlike(pattern))
        .withColumns({"_old": F.regexp_extract(head, pattern, 1), "file": F.regexp_extract(head, pattern, 2), "_lines": lines})
        .withColumns({
            "status": status,
            "additions": F.size(F.filter("_lines", plus)),
            "deletions": F.size(F.filter("_lines", minus)),
            "diff": F.array_join(kept, "\n"),
        })
        .withColumn("old_file", F.when(F.col("status") == "renamed", F.col("_old")))
        .select(*others, "file", "status", "additions", "deletions", "diff", "old_file", "ord")
    )
