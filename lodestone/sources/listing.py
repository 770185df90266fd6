"""Folders listed in tasks: a frontier of folders, expanded level by level.

``listed`` gives the same files as the corpus source's scan, in the same order, but no list of names passes through the
driver: each level's folders are dealt over tasks, which read their entries and look into files of unknown kind, and the
levels are tables on shared storage. With ``max_files`` the files found so far bound what can still be among the first in
depth-first order, so folders behind that bound are not entered. ``contents`` reads what is left of a listing, so that a
condition on it decides what is opened.

With follow_links a folder that several links lead to is listed once, where it is least deep, then first in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import Patterns, gitignore_patterns, is_text, modified
from .tables import stored

ENTRY = pa.schema([("file", pa.string()), ("depth", pa.int32()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("real", pa.string())])
ENTRIES = "file string, depth int, is_dir boolean, size bigint, last_modified timestamp, real string"
FOLDERS_A_TASK = 200
FILES_A_TASK = 2000
BYTES_A_TASK = 64 << 20
BATCH_BYTES = 8 << 20


def depth_first(file: Column) -> Column:
    """Sorts like a walk that takes entries by name: by folder after folder."""
    return F.replace(file, F.lit("/"), F.lit("\0"))


def _tasks(spark: SparkSession, rows: int, each: int) -> int:
    return max(1, min(rows, max(spark.sparkContext.defaultParallelism, -(-rows // each))))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)


def expanded(folders: DataFrame, root: str, how: dict, tasks: int) -> DataFrame:
    """The entries of folders (file, depth) that the patterns leave."""
    ignore = gitignore_patterns(root) if how["gitignore"] else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, out, ignored = Patterns(how["include"], how["dialect"]), Patterns([p for p in how["exclude"] if not p.startswith("!")], how["dialect"]), Patterns(ignore)
        rows: list[tuple] = []
        for batch in batches:
            for folder, depth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    entries = os.scandir(os.path.join(root, folder))
                except OSError:
                    continue
                with entries:
                    for e in entries:
                        path = f"{folder}/{e.name}" if folder else e.name
                        if e.is_symlink() and not how["follow_links"] or ignored.match(path) or out.match(path):
                            continue
                        try:
                            if e.is_dir():
                                rows.append((path, depth + 1, True, None, None, os.path.realpath(e.path) if how["follow_links"] else None))
                            elif not wanted or wanted.match(path):
                                stat = e.stat()
                                rows.append((path, depth, False, stat.st_size, modified(stat), None))
                        except OSError:
                            continue  # gone since it was listed
                        if len(rows) >= 5000:
                            yield _batch(rows)
                            rows.clear()
        if rows:
            yield _batch(rows)

    return folders.select("file", "depth").repartition(tasks, "file").mapInArrow(run, ENTRIES)


def texts(files: DataFrame, root: str, tasks: int) -> DataFrame:
    """Files that are text by name or by a look inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def is_one(file: str) -> bool:
            name = file.rsplit("/", 1)[-1]
            if is_text(name, b""):
                return True
            try:
                with open(os.path.join(root, file), "rb") as f:
                    return is_text(name, f.read(1024))
            except OSError:
                return False

        for batch in batches:
            yield batch.filter(pa.array([is_one(f) for f in batch.column(0).to_pylist()], pa.bool_()))

    return files.repartition(tasks, "file").mapInArrow(run, files.schema)


def listed(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, dialect: str = "scanner", gitignore: bool = True, follow_links: bool = False, max_depth: int = 10, text_only: bool = True, max_files: int | None = None) -> DataFrame:
    """path, file (relative), size and last_modified of the files below a folder that all executors see."""
    how = {"include": include or [], "exclude": exclude or [], "dialect": dialect, "gitignore": gitignore, "follow_links": follow_links}
    columns = ["file", "size", "last_modified"]
    if os.path.isfile(root):
        stat, base = os.stat(root), os.path.dirname(root)
        found = spark.createDataFrame([(os.path.basename(root), stat.st_size, modified(stat))], "file string, size bigint, last_modified timestamp")
    else:
        base, found = root, spark.createDataFrame([], "file string, size bigint, last_modified timestamp")
        frontier = spark.createDataFrame([("", 0, os.path.realpath(root))], "file string, depth int, real string")
        seen, n = frontier.select("real"), 1
        while n:
            entries = stored(expanded(frontier, root, how, _tasks(spark, n, FOLDERS_A_TASK)), "entries")
            files = entries.where("NOT is_dir").select(*columns)
            if text_only:
                files = stored(texts(files, root, _tasks(spark, files.count(), FILES_A_TASK)), "texts")
            found = found.unionByName(files)
            frontier = entries.where(f"is_dir AND depth <= {max_depth}").select("file", "depth", "real")
            if follow_links:
                once = frontier.groupBy("real").agg(F.min_by(F.struct("file", "depth"), depth_first(F.col("file"))).alias("e")).select("e.*", "real")
                frontier = stored(once.join(seen, "real", "left_anti"), "frontier")
                seen = seen.unionByName(frontier.select("real"))
            if max_files is not None:
                frontier = frontier.where(_before_bound(found, max_files))
            n = frontier.count()
    key = depth_first(F.col("file"))
    found = found.select(F.concat(F.lit(base + "/" if base else ""), "file").alias("path"), *columns)
    return found if max_files is None else found.orderBy(key).limit(max_files)


def _before_bound(found: DataFrame, max_files: int) -> Column:
    """Whether a folder comes before the last of the first files; true while there are fewer."""
    key = depth_first(F.col("file"))
    n, last = found.select(key.alias("key")).orderBy("key").limit(max_files).agg(F.count("*"), F.max("key")).first()  # one row
    return key < F.lit(last) if n == max_files and n else F.lit(max_files > 0)


def contents(files: DataFrame, on_error: str = "row") -> DataFrame:
    """Listed files (path, file, size, last_modified) with content and error; batches are bounded by bytes. A file that cannot
    be read is a row without content, or none with ``on_error='drop'``."""
    spark = files.sparkSession
    total, n = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = max(1, _tasks(spark, n, FILES_A_TASK), -(-total // BYTES_A_TASK))
    schema = pa.schema([("path", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("content", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, texts, errors = 0, 0, [], []
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        data = f.read().decode("utf-8", "replace")
                    texts.append(data), errors.append(None)
                    held += len(data)
                except OSError as e:
                    texts.append(None), errors.append(f"Failed to read {batch.column(1)[k].as_py()}: {e.strerror}")
                if held >= BATCH_BYTES or k + 1 == batch.num_rows:
                    columns = [c.slice(start, len(texts)) for c in batch.columns]
                    out = pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, schema, strict=False)), pa.array(texts, pa.string()), pa.array(errors, pa.string())], schema=schema)
                    yield out if on_error == "row" else out.filter(pc.is_null(out.column("error")))
                    start, held, texts, errors = k + 1, 0, [], []

    out = files.select("path", "file", "size", "last_modified").repartition(tasks, "path").mapInArrow(run, "path string, file string, size bigint, last_modified timestamp, content string, error string")
    return out if on_error == "row" else out.drop("error")
