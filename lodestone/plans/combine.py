"""Combine: whole files in one document; and extract: changes in one document."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import globs
from ..operators import selector as S
from ..schemas import CombineOptions, ExtractOptions, Metadata
from ..sources.tables import stored
from . import parts, render


def as_changes(files: DataFrame) -> DataFrame:
    more = [c for c in ("last_modified", "file_size") if c in files.columns]
    return files.select("file", F.lit("added").alias("status"), T.line_count(F.col("content")).cast("int").alias("additions"), F.lit(0).alias("deletions"), F.lit("").alias("diff"), "content", "ord", *more)


def pick(files: DataFrame, options: CombineOptions) -> DataFrame:
    """The first max_files files by name that the patterns let through."""
    kept = files.where(globs.path_filter(F.col("file"), options.include, globs.combine_excludes() + options.exclude))
    return kept.orderBy("file").limit(options.max_files)


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("total_additions"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("total_deletions"))


def combine(files: DataFrame, options: CombineOptions | None = None) -> DataFrame:
    options = options or CombineOptions()
    rows = as_changes(pick(files.withColumn("ord", F.col("file")), options))
    return {"txt": render.combine_txt, "md": render.combine_md, "json": render.combine_json}[options.format](rows)


def combine_paths(spark: SparkSession, paths: list[str], options: CombineOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """The document of listed files and folders, and the errors of paths that give none."""
    from ..sources.paths import collect

    options = options or CombineOptions()
    exclude = [p for p in globs.combine_excludes() + options.exclude if not p.startswith("!")]
    files, errors = collect(spark, paths, include=",".join(options.include), exclude=",".join(exclude), max_files=str(options.max_files), max_depth=str(options.max_depth), gitignore=str(not options.no_gitignore))
    rows = in_order(as_changes(files.withColumn("file_size", F.col("size"))), options.sort_by, options.sort_order)
    document = {"txt": render.combine_txt, "md": render.combine_md, "json": render.combine_json}[options.format](rows)
    if options.output:
        write_rows(rows, document, options.format, options.output)
    return document, errors


def write_rows(rows: DataFrame, document: DataFrame, fmt: str, path: str) -> str:
    """Writes the rows' document to a named file, over many tasks but for JSON; returns its whole path."""
    if fmt == "json":
        return write(document, path)
    return parts.write(render.combine_pieces(stored(rows, "rows"), fmt), os.path.abspath(path))


def in_order(rows: DataFrame, sort_by: str | None, sort_order: str) -> DataFrame:
    """Rows whose ord follows the order asked for."""
    if not sort_by:
        return rows
    return S.places(rows, S.sort_keys(sort_by, sort_order == "desc"), "_place").withColumn("ord", F.col("_place")).drop("_place")


def choose(rows: DataFrame, options: ExtractOptions) -> DataFrame:
    """The changes that options name, and in their order."""
    rows = C.filter_changes(rows, options.path, options.types)
    if options.selected_files:
        rows = rows.where(F.col("file").isin(*options.selected_files))
    if options.filter_by != "all":
        rows = rows.where(S.status_filter(options.filter_by))
    return in_order(rows, options.sort_by, options.sort_order)


def extract(rows: DataFrame, contents: DataFrame, options: ExtractOptions, metadata: str | Metadata | None = None, untracked: DataFrame | None = None) -> DataFrame:
    """changes and HEAD contents to one document. Metadata may be a text, for Markdown, or in parts."""
    rows = choose(rows, options)
    if options.include_untracked and untracked is not None:
        if options.untracked_pattern:
            untracked = untracked.where(globs.base_match(F.col("file"), options.untracked_pattern))
        rows = C.union_untracked(rows, untracked)
        contents = contents.select("file", "content").unionByName(untracked.select("file", "content")).dropDuplicates(["file"])
    shown = C.smart_context(rows, contents, options.full, options.diff_only)
    if options.format == "txt":
        return render.extract_txt(shown)
    metadata, scope = None if options.no_metadata else metadata, C.scope(shown)
    if isinstance(metadata, Metadata):
        scope = scope.crossJoin(F.broadcast(C.token_estimate(shown)))  # one row each
    if options.format == "md":
        return render.extract_md(shown, scope, render.metadata_column(metadata, F.col("estimated")) if isinstance(metadata, Metadata) else metadata)
    return render.extract_json(shown, scope, render.metadata_struct(metadata, F.col("estimated")) if isinstance(metadata, Metadata) else None)


def extract_repository(spark: SparkSession, repo: str, options: ExtractOptions) -> DataFrame:
    """Extract of a working tree: a range, the staged, all, or (without either) the feature branch's, staged or
    current changes, whichever is there first."""
    from ..sources import git

    git.register(spark)
    if options.range:
        rows = git.changes(spark, repo, **git.parse_range(options.range))
    elif options.staged:
        rows = git.changes(spark, repo, mode="staged")
    elif options.all:
        rows = C.merge_changes(git.changes(spark, repo, mode="staged"), git.changes(spark, repo, mode="current"))
    elif git.is_feature_branch(git.current_branch(repo)) and git.main_branch(repo):
        rows = git.changes(spark, repo, mode="feature")
    else:
        rows = git.changes(spark, repo, mode="staged" if git.has_staged_changes(spark, repo) else "current")
    blobs = spark.read.format("gitblob").option("repo", repo).load().where(F.col("content").isNotNull()).select("file", "content")
    untracked = None
    if options.include_untracked:
        names = [r.file for r in spark.read.format("gitfiles").option("repo", repo).load().collect()]  # names of one working tree
        new = spark.read.format("gitblob").options(repo=repo, files="\n".join(names)).load() if names else blobs.limit(0).withColumn("in_head", F.lit(False))
        untracked = new.where("content IS NOT NULL").select("file", "content", F.xxhash64("file").alias("ord"))
    method = C.extract_method(options.range, options.staged, options.all, False, git.is_feature_branch(git.current_branch(repo)))
    about = spark.read.format("gitmeta").option("repo", repo).load().first()
    generated = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    metadata = Metadata(generated, about.repository, about.branch, about.commit, method, options.path, options.types)
    return extract(rows, blobs, options, metadata, untracked)


def write(document: DataFrame, path: str) -> str:
    """Writes the document to a named file; returns its whole path."""
    path = os.path.abspath(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(document.first().document)
    return path


def save(document: DataFrame, root: str, command: str, context: str, fmt: str, tool: str = "lodestone") -> str:
    """Writes the document under the tool's folder; returns the path."""
    row = document.select("document", T.output_name(tool, command, F.lit(context), fmt).alias("name")).first()
    folder = os.path.join(root, f".{tool}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, row.name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(row.document)
    return path
