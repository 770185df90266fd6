"""Sharding by a two-pass external shuffle.

Pass one scatters the rows over buckets by a seeded hash of the whole row; a bucket fits into memory, however many rows
one doc_id or one text has. Pass two puts each bucket into a fixed order, shuffles it by Fisher-Yates under a seed of its
own and writes it. Only the orders are made in Python, as one array of row numbers a bucket, which a sort-merge join brings
to the bucket's rows; the texts stay in Spark's rows, which are sorted and may spill. The buckets one after the other
are a random order of all rows; row number p of N goes to shard p * shards // N, so that the shards' row counts are at
most one apart, whatever the sizes of texts or of groups of copies.

The number of buckets grows with the table without a bound. Where a bucket begins in the whole order is summed up in
tasks, each over a part of the buckets; the driver only has the sums of at most 4096 such parts.

The seed decides all: a task that runs again writes the same rows at the same places. Null doc_ids and texts take part
in the hash as nulls. Null texts stay null. Repeated rows are rows of their own, with slots of their own; rows without
any difference may stand for each other and share a bucket, whose task then holds 4 bytes for each of its rows. Columns of maps,
which have no hash, do not scatter. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import fresh, scratch_path, stored


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A random order of n rows: from the end, each place swaps with one at or before it."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else order
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


#: Parts of the buckets whose sums come to the driver.
PARTS = 4096


def bucketed(docs: DataFrame, bucket: str, seed: int, buckets: int) -> DataFrame:
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return docs.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets)))


def bucket_orders(counts: DataFrame, seed: int, names: list[str], buckets: int) -> tuple[DataFrame, int]:
    """For each bucket of counts (b long, n long): a random order of its rows and how many rows are in all buckets before it,
    under the names given; and the number of all rows."""
    width = -(-buckets // PARTS)
    counts = counts.withColumn("part", F.expr(f"b div {width}"))
    sums = dict(counts.groupBy("part").agg(F.sum("n")).collect())  # at most PARTS rows
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    starts = counts.sparkSession.createDataFrame(before, "part long, base long")
    running = F.sum("n").over(W.partitionBy("part").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.join(F.broadcast(starts), "part").select("b", "n", (F.col("base") + running - F.col("n")).alias("offset"))

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order = pa.array([fisher_yates(n, np.random.default_rng([seed, b])).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), order, pa.array([offset], pa.int64())], names=names)

    return placed.mapInArrow(shuffled, "`{}` long, `{}` array<int>, `{}` long".format(*names)), total


def sharded(docs: DataFrame, shards: int, seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """docs' columns, the row's shard and its slot there, as the last two."""
    bucket, shard, slot, number, at = (fresh(docs, c) for c in ("bucket", "shard", "slot", "number", "at"))
    names = [fresh(docs, c) for c in ("order_bucket", "order", "order_offset")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = bucketed(docs, bucket, seed, buckets)
    counts, _ = stored(scattered.groupBy(F.col(bucket).alias("b")).agg(F.count("*").alias("n")), "buckets")
    orders, rows = bucket_orders(counts, seed, names, buckets)
    # a fixed order first, as rows arrive in any
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rank = F.row_number().over(W.partitionBy(bucket).orderBy(F.xxhash64(*columns), F.xxhash64(F.lit(seed + 1), *columns)))
    # by the bucket alone, so the window's partitions are the join's, too
    placed = scattered.withColumn(number, rank).join(orders.hint("merge"), F.col(bucket) == F.col(names[0]))
    placed = placed.withColumn(at, F.col(names[2]) + F.element_at(names[1], F.col(number))).withColumn(shard, F.expr(f"cast(`{at}` * {shards} div {max(1, rows)} as int)"))
    first = F.expr(f"(cast(`{shard}` as bigint) * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn(slot, F.col(at) - first).select(*docs.columns, shard, slot)


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 8 << 20, path: str | None = None) -> tuple[DataFrame, str]:
    """Writes all columns of docs as Parquet under ``path`` (a scratch folder if None), one folder a shard, with the
    row's place in its shard as ``slot``; returns the table read back and the path. If docs has columns named shard
    or slot, the new ones get leading underscores. A bucket has about ``bucket_bytes`` of text."""
    path = path or scratch_path(docs.sparkSession, "shards")
    out = sharded(docs, shards, seed, bucket_bytes)
    shard, slot = out.columns[-2:]
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    fields = [*[f for f in out.schema.fields if f.name != shard], T.StructField(shard, T.IntegerType())]
    return docs.sparkSession.read.schema(T.StructType(fields)).parquet(path), path
