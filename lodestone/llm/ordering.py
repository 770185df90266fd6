"""Places in an order by sorted runs, and streams of sorted rows by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored


def sorted_runs(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, str]:
    """df in sorted runs, stored: each row with its run and its number ``mid`` there (rising, gapless). What has been stored
    does not change, so that a task that runs again finds the same numbers."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    return stored(cut.withColumn("run", F.shiftright("mid", 33)), name)


def run_offsets(runs: DataFrame, group: str) -> DataFrame:
    """(group, run, offset): a row of that group and run has the place offset + mid in its group; size: the group's rows. There
    are as many rows as groups and runs at most."""
    counts = runs.groupBy(group, "run").agg(F.count("*").alias("c"), F.min("mid").alias("first"))
    before = F.sum("c").over(W.partitionBy(group).orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")
    return counts.select(group, "run", (before - F.col("first")).alias("offset"), F.sum("c").over(W.partitionBy(group)).alias("size"))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``place`` (from 0) in one order of all rows, and ``size``, their number. The order must be total, or rows that
    tie must be able to stand for each other."""
    runs, _ = sorted_runs(df.withColumn("all", F.lit(0)), order, name)
    offsets = run_offsets(runs, "all").drop("all")
    return runs.join(offsets, "run").select(*df.columns, (F.col("offset") + F.col("mid")).alias("place"), "size")


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key, which come one after the other; the first ``keys`` columns, integers without nulls, are the
    key. One key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)
