"""The relational core of extract: change sets merged, filtered, completed by contents and summed up.

Every relation carries ``ord``, so that the order that users see does not depend on the order of a scan. Changes have
file, status, additions, deletions, diff, old_file and ord; contents have file and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import globs


def merge_changes(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """Full outer join on the file: of a file in both, counts add up, diffs are joined by a line feed, all else is the
    staged row's. Staged order first, then new unstaged files in theirs."""
    s = staged.select("file", *[F.col(c).alias(f"s_{c}") for c in staged.columns if c != "file"])
    u = unstaged.select("file", *[F.col(c).alias(f"u_{c}") for c in unstaged.columns if c != "file"])
    both = F.col("s_ord").isNotNull() & F.col("u_ord").isNotNull()
    pick = lambda c: F.coalesce(f"s_{c}", f"u_{c}") if c != "old_file" else F.when(F.col("s_ord").isNotNull(), F.col("s_old_file")).otherwise(F.col("u_old_file"))
    total = lambda c: F.coalesce(F.col(f"s_{c}"), F.lit(0)) + F.coalesce(F.col(f"u_{c}"), F.lit(0))
    return s.join(u, "file", "full_outer").select(
        "file",
        pick("status").alias("status"),
        total("additions").alias("additions"),
        total("deletions").alias("deletions"),
        F.when(both, F.concat_ws("\n", "s_diff", "u_diff")).otherwise(pick("diff")).alias("diff"),
        pick("old_file").alias("old_file"),
        F.struct(F.col("s_ord").isNull().alias("late"), pick("ord").alias("ord")).alias("ord"),
    )


def filter_changes(changes: DataFrame, path: str | None = None, types: list[str] | None = None) -> DataFrame:
    if path:
        changes = changes.where(globs.base_match(F.col("file"), path))
    return changes.where(globs.ends_with_types(F.col("file"), types)) if types else changes


def untracked_changes(contents: DataFrame) -> DataFrame:
    """Files (file, content, ord) as added ones: each line an addition."""
    return contents.select("file", F.lit("added").alias("status"), T.line_count(F.col("content")).cast("int").alias("additions"), F.lit(0).alias("deletions"), T.added_diff(F.col("content")).alias("diff"), F.lit(None).cast("string").alias("old_file"), "ord")


def union_untracked(changes: DataFrame, contents: DataFrame) -> DataFrame:
    last = F.struct(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"))
    first = F.struct(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"))
    return changes.withColumn("ord", first).unionByName(untracked_changes(contents).withColumn("ord", last))


def shows_full(status: Column, additions: Column, deletions: Column, content: Column, manual: Column | None = None) -> Column:
    """Smart context: an added file under 50 lines, a modified one of which over 40 % changed, or any file but a
    deleted one that the manual pattern names."""
    lines = T.line_count(content)
    rule = ((status == "added") & (lines < 50)) | ((status == "modified") & (T.change_percent(additions, deletions, lines) > 40))
    if manual is not None:
        rule = rule | manual
    return F.coalesce((status != "deleted") & content.isNotNull() & rule, F.lit(False))


def smart_context(changes: DataFrame, contents: DataFrame, manual: str | None = None, diff_only: bool = False) -> DataFrame:
    """changes with full_content, the file's content where the rule shows it."""
    joined = changes.join(contents.select("file", F.col("content").alias("_content")), "file", "left")
    pattern = globs.base_match(F.col("file"), manual) if manual else None
    rule = F.lit(False) if diff_only else shows_full(F.col("status"), F.col("additions"), F.col("deletions"), F.col("_content"), pattern)
    return joined.withColumn("full_content", F.when(rule, F.col("_content"))).drop("_content")


def scope(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return changes.groupBy(*(by or [])).agg(F.count("*").alias("files_changed"), F.lit(0).cast("long").alias("functions_modified"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("lines_added"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("lines_deleted"))


def token_estimate(shown: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of diffs and full contents together: a diff counts even where the full file is shown."""
    return shown.groupBy(*(by or [])).agg(F.ceil((F.coalesce(F.sum(F.length("diff")), F.lit(0)) + F.coalesce(F.sum(F.length("full_content")), F.lit(0))) / 4).cast("long").alias("estimated"))


def token_savings(shown: DataFrame, contents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Over all but deleted files: tokens of what is shown against tokens of whole files."""
    whole = shown.where("status <> 'deleted'").join(contents.select("file", F.col("content").alias("_content")), "file", "left")
    actual = F.sum(T.estimate_tokens(F.coalesce("full_content", "diff", F.lit(""))))
    full = F.sum(T.estimate_tokens(F.coalesce("_content", "diff", F.lit(""))))
    out = whole.groupBy(*(by or [])).agg(F.coalesce(full, F.lit(0)).cast("long").alias("full_file_tokens"), F.coalesce(actual, F.lit(0)).cast("long").alias("actual_tokens"))
    saved = F.col("full_file_tokens") - F.col("actual_tokens")
    percent = F.when(F.col("full_file_tokens") > 0, T.js_round(saved * 100.0 / F.col("full_file_tokens"))).otherwise(F.lit(0).cast("long"))
    return out.withColumn("saved", saved).withColumn("percent_saved", percent)


def notice_counts(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """How many changes there are, and how many unstaged ones a staged extract leaves out."""
    return staged.agg(F.count("*").alias("total_changes")).crossJoin(F.broadcast(unstaged.agg(F.count("*").alias("not_included"))))  # one row each


def selected_changes(files: DataFrame) -> DataFrame:
    """Picked files (path, content, last_modified, ord) as added ones; unreadable ones (null content) are left out."""
    known = files.where(F.col("content").isNotNull()).withColumnRenamed("path", "file")
    return untracked_changes(known).join(known.select("file", "last_modified"), "file")


def listed_changes(files: DataFrame) -> DataFrame:
    """Listed files (file, last_modified, null where a file cannot be read, ord) as added ones without content: no line
    is counted yet. Folders (is_directory, if there) are left out."""
    kept = files.where("NOT coalesce(is_directory, false)") if "is_directory" in files.columns else files
    return kept.select("file", F.lit("added").alias("status"), F.lit(0).alias("additions"), F.lit(0).alias("deletions"), F.lit("").alias("diff"), F.lit(None).cast("string").alias("old_file"), "last_modified", "ord")


def with_modification_times(changes: DataFrame, listing: DataFrame) -> DataFrame:
    return changes.join(listing.select(F.col("relative_path").alias("file"), "last_modified"), "file", "left")


def enhance(changes: DataFrame, listing: DataFrame, staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """File sizes and in which of the three sets a file is: joins as flags."""
    out = changes.join(listing.select(F.col("relative_path").alias("file"), F.col("size").alias("file_size")), "file", "left")
    for name, rows in (("is_staged", staged), ("is_unstaged", unstaged), ("is_untracked", untracked)):
        out = out.join(rows.select("file").distinct().withColumn(name, F.lit(True)), "file", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def staged_existing(changes: DataFrame, listing: DataFrame) -> DataFrame:
    """Staged files that can be combined: not deleted, and there."""
    return changes.where("status <> 'deleted'").join(listing.select(F.col("relative_path").alias("file")), "file", "left_semi")


def extract_method(range_: str | None, staged: bool, all_: bool, session: bool, feature_branch: bool) -> str:
    """The name of an extract's context, by priority."""
    return range_ or ("staged" if staged else "all" if all_ else "session" if session else "feature-branch" if feature_branch else "current")
