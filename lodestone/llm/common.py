"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words in the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows and bytes that Spark puts into one Arrow batch of texts; bound the batch's memory outside the heap.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Bytes of text that operators in Python work on at a time, but at least one text.
SLICE_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: bounds the session's Arrow batches by BATCH_ROWS rows and BATCH_BYTES bytes, unless it has
    lower bounds already."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.sub(r"\D", "", spark.conf.get(key)) or "0"
        if not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about SLICE_BYTES in a text column, and 1024 rows at most."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) if batch.num_rows else np.zeros(0, np.int64)
        upto, i = np.cumsum(sizes), 0
        while i < batch.num_rows:
            before = upto[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right"))), i + 1024, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def column_of(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A table of one string column, without a Python worker."""
    if not values:
        return spark.range(0).select(F.lit("").alias(name))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir. Where that is unset, a
    temporary folder is made and set in local mode; a cluster's executors would not share it, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is still there when the driver's Python ends is deleted."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, unless the session has ended before. That it cannot be deleted is a warning: it is no result."""
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except (Py4JError, OSError) as e:
        warnings.warn(f"{path} is left behind: {e}", stacklevel=2)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written once to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver
    collects its garbage; a driver with much memory does so too late for the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else untouched (lower() also changes other alphabets)."""
    return F.translate(col, UPPER, UPPER.lower())


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, for columns that an operator needs for itself."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
