"""What comes to the driver stays small: the words of a bitmap take a few times the bitmap's bytes, not rows of Python."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jaccard


@pytest.mark.parametrize("hashed", [True, False])
def test_bitmaps_come_as_words(spark, hashed):
    bits, n = 1 << 22, 200_000
    values = spark.range(n).select((F.col("id") * 1_000_003 - 7).alias("v"))
    rows = np.arange(n, dtype=np.int64) * 1_000_003 - 7
    if not hashed:
        rows = values.select(F.xxhash64("v").alias("h")).toArrow().column(0).to_numpy()
    tracemalloc.start()
    found = jaccard.bits_of(values, "v", bits, hashed=hashed)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    want = np.zeros(bits, bool)
    want[rows % bits] = True
    assert (np.unpackbits(found, bitorder="little").astype(bool) == want).all()
    assert most < 4 * bits // 8


def test_no_values(spark):
    assert not jaccard.bits_of(spark.range(0).select(F.col("id").alias("v")), "v", 1 << 16).any()


@pytest.mark.parametrize("stage", [corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates])
def test_stages_collect_no_rows_but_the_sketch(spark, sf, stage, monkeypatch):
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(40)) + " end" * k) for i in range(300) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    collected = []
    kind = type(docs)
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: collected.append(f(self)) or collected[-1])
    kept = stage(spark, docs, sf).select("doc_id")
    assert max(map(len, collected)) <= 1 << 20 - jaccard.CHUNK_BITS
    assert sorted(r[0] for r in kept.toLocalIterator()) == list(range(0, 600, 2))
