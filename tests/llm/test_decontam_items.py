"""Short items inside longer texts, and items that share a prompt."""

from __future__ import annotations

import glob
import os

import duckdb

from lodestone.llm import decontam, queries

from . import messy

PROMPT = "please answer the following question with the one letter of the right choice and nothing else at all"


def test_short_items_are_found_inside_texts(spark):
    docs = messy.documents(spark, [(1, "The zebra quartz lantern was seen at noon today"), (2, "zebra quartz"), (3, "Zebra! Quartz? LANTERN."), (4, "quartz lantern zebra " * 9), (5, None), (6, "noon")])
    items = [(1, "zebra quartz lantern"), (2, "noon"), (3, "quartz lantern zebra quartz"), (4, "seen at noon today"), (5, ""), (6, "lantern was not")]
    got = decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 2), (1, 4), (3, 1), (4, 1), (4, 3), (6, 2)]
    assert all((r.n_item, r.n_common, r.containment) == (1, 1, 1.0) for r in got)


def test_short_items_in_sql(spark, sf, tmp_path):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r.text.split()[2:5] for r in docs.orderBy("doc_id").limit(4).collect()]
    items = [(k, " ".join(w[: k + 1])) for k, w in enumerate(some)] + [(r.item_id + 100, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/b")
    c.sql(f"create or replace view benchmark as select * from '{tmp_path}/b/*.parquet'")
    want = c.sql(queries.SQL["op1_decontamination"])
    got = decontam.find_leaks(docs, spark.read.parquet(f"{tmp_path}/b")).select(*want.columns).collect()
    assert len({r.item_id for r in got} & {0, 1, 2, 3}) == 4 and messy.cells(got) == messy.cells(want.fetchall())


def test_a_shared_prompt_brings_no_candidates(spark):
    n = 300
    docs = messy.documents(spark, [(k, f"{messy.prose(k, 60)} {PROMPT} {messy.prose(k + 5000, 60)}") for k in range(n)])
    items = spark.createDataFrame([(k, f"{PROMPT} {messy.prose(k + 9000, 25)}") for k in range(n)] + [(n, f"{messy.prose(3 + 5000, 60)}")], "item_id long, text string")
    met = decontam.sketches(decontam.item_words(items), 80, 5).selectExpr("item", "explode(sketch) AS key")
    shared = docs.selectExpr("doc_id", "text").select("doc_id", decontam.shingle_hashes(docs["text"]).alias("h")).selectExpr("doc_id", "explode(h) AS key")
    assert shared.join(met, "key").count() < 60  # of 90,000 pairs that have the prompt in common
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()] == [(3, n)]
