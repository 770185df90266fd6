"""The shards' order, worked out again; hot doc_ids; the plan."""

from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import queries, sharding

from . import messy


def test_order_is_recomputed(spark):
    docs = messy.documents(spark, [*messy.TEXTS, *[(k, messy.prose(k, 30)) for k in range(200)]])
    size = sum(len((r.text or "").encode()) + 16 for r in docs.collect())
    for bucket_bytes in (4_000, 1 << 30):
        buckets = -(-size // bucket_bytes)
        columns = docs.columns
        keyed = sharding.bucketed(docs, "_b", 17, buckets).withColumns({"_h": F.xxhash64(*columns), "_i": F.xxhash64(F.lit(18), *columns)})
        rows = sorted((r._b, r._h, r._i, str(r.doc_id), str(r.text)) for r in keyed.collect())
        order, n = [None] * len(rows), collections.Counter(r[0] for r in rows)
        base = 0
        for b in sorted(n):
            mine = [r for r in rows if r[0] == b]
            for r, p in zip(mine, sharding.fisher_yates(n[b], np.random.default_rng([17, b])).tolist(), strict=True):
                order[base + p] = r[3:]
            base += n[b]
        want = [[] for _ in range(7)]
        for p, x in enumerate(order):
            want[p * 7 // len(order)].append(x)
        got, _ = sharding.shuffle_into_shards(docs, 7, bucket_bytes=bucket_bytes)
        found = sorted((r["_shard"], r["_slot"], str(r.doc_id), str(r.text)) for r in got.select("_shard", "_slot", "doc_id", "text").collect())
        assert found == [(s, k, *x) for s, part in enumerate(want) for k, x in enumerate(part)]
        assert len(n) > 20 or bucket_bytes > size


def test_rows_of_one_doc_id_spread(spark):
    docs = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    counts = [r["count"] for r in sharding.bucketed(docs, "b", 17, 100).groupBy("b").count().collect()]
    assert len(counts) == 100 and max(counts) < 1300
    same = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    counts = [r["count"] for r in sharding.bucketed(same, "b", 17, 100).groupBy("b").count().collect()]
    assert len(counts) == 100 and max(counts) < 1300


def test_orders_are_not_broadcast(spark):
    plan = sharding.sharded(messy.documents(spark), 7)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")].splitlines()
    joins = [line for line in above if "Join" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0] and "BroadcastExchange" not in "".join(above)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"rows"}
    assert all(r.size == len((docs[r.doc_id] or "").encode()) + 16 for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
