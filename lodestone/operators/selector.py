"""What a file picker computes: filters, searches, orders, sums by directory and paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.storagelevel import StorageLevel

from ..functions import text as T

SORTS = ("name", "updated", "size", "status")


def status_filter(kind: str) -> Column:
    """Which rows (status, is_staged, is_unstaged, is_untracked) a filter keeps."""
    if kind == "all":
        return F.lit(True)
    if kind in ("staged", "unstaged", "untracked"):
        return F.col(f"is_{kind}")
    if kind in ("modified", "added", "deleted"):
        return F.col("status") == kind
    raise ValueError(f"unknown filter {kind!r}")


def search(path: Column, query: str) -> Column:
    """A part of the path in any case, or its letters in order in the path or in the base name."""
    if not query:
        return F.lit(True)
    low = F.lower(path)
    letters = "(?s)" + ".*".join(re.sub(r"([^a-z0-9_])", r"\\\1", c) if ord(c) < 128 else c for c in query.lower())
    return low.contains(query.lower()) | low.rlike(letters) | T.basename(low).rlike(letters)


def sort_keys(by: str = "name", descending: bool = False) -> list[Column]:
    """Stable through ord; files without a time come first upwards, last downwards."""
    column = {"name": "file", "updated": "last_modified", "size": "file_size", "status": "status"}[by]
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_first(column), F.asc("ord")]


def places(df: DataFrame, keys: list[Column], name: str = "place") -> DataFrame:
    """df with the row's place, from 1, in the order of the keys: sorted in ranges, numbered within each. Only a count for
    each range comes to the driver. The ranges are kept on disk, as a second run might cut them elsewhere."""
    cut = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    counts = sorted(map(tuple, cut.groupBy("_range").count().collect()))  # one row a partition
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    number = F.row_number().over(W.partitionBy("_range").orderBy(*keys))
    return cut.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_before") + number).alias(name))


def panel_sort_keys(by: str = "name") -> list[Column]:
    """The panel's order: latest and largest first, names and states upwards."""
    return sort_keys(by, descending=by in ("updated", "size"))


def file_token_estimate(files: DataFrame) -> DataFrame:
    return files.withColumn("token_estimate", T.file_tokens(F.col("file"), F.col("file_size"), F.col("additions"), F.col("deletions")))


def directory_metrics(files: DataFrame) -> DataFrame:
    """By directory: files, tokens, bytes, latest change, the first file's status and how many are in which state. A
    file counts as staged, else unstaged, else untracked."""
    state = F.when(F.col("is_staged"), "staged").when(F.col("is_unstaged"), "unstaged").when(F.col("is_untracked"), "untracked")
    d = files.withColumn("directory", T.directory(F.col("file"))).withColumn("_state", state)
    return d.groupBy("directory").agg(
        F.count("*").alias("files"),
        F.sum("token_estimate").cast("long").alias("tokens"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"),
        F.max("last_modified").alias("last_modified"),
        F.min_by("status", "ord").alias("status"),
        *[F.count_if(F.col("_state") == s).alias(s) for s in ("staged", "unstaged", "untracked")],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted")],
    )


def directory_order(by: str = "name") -> list[Column]:
    return {"name": [F.asc("directory")], "updated": [F.desc_nulls_last("last_modified"), F.asc("directory")], "size": [F.desc("tokens"), F.asc("directory")], "status": [F.asc("status"), F.asc("directory")]}[by]


def header_state(files: DataFrame) -> DataFrame:
    """By directory: whether all files are selected, or some but not all."""
    d = files.withColumn("directory", T.directory(F.col("file"))).groupBy("directory")
    every, some = F.bool_and("selected"), F.bool_or("selected")
    return d.agg(F.count("*").alias("files"), every.alias("selected"), (some & ~every).alias("mixed"))


def with_headers(files: DataFrame) -> DataFrame:
    """Header rows by directory and the files below them, in display order."""
    heads = header_state(files).select("directory", F.lit(None).cast("string").alias("file"), F.lit(True).alias("is_header"), "files", "selected", "mixed")
    rows = files.select(T.directory(F.col("file")).alias("directory"), "file", F.lit(False).alias("is_header"), F.lit(1).cast("long").alias("files"), "selected", F.lit(False).alias("mixed"))
    return heads.unionByName(rows).orderBy("directory", F.desc("is_header"), "file")


def selection_stats(files: DataFrame) -> DataFrame:
    return files.where("selected").agg(F.count("*").alias("files"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("deletions"), F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("long").alias("tokens"))


def page(files: DataFrame, keys: list[Column], cursor: int, height: int, total: int) -> DataFrame:
    """The rows of a window of some height around the cursor."""
    start = max(0, min(cursor - height // 2, total - height))
    return files.orderBy(*keys).offset(start).limit(height)


def last_of(df: DataFrame, parent: str, *order: Column) -> DataFrame:
    """df with is_last: whether a row is the last of its siblings."""
    w = W.partitionBy(parent).orderBy(*order)
    return df.withColumn("is_last", F.lead(F.lit(True)).over(w).isNull())
