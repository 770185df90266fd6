"""The pipeline, and the queries that have SQL, over the driver's smallest tables."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm import pieces, queries, rules

from . import messy
from .messy import cells
from .test_messy_documents import brute_statistics


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, sf), c.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert cells(got.select(*columns).collect()) == cells([[r[want.columns.index(x)] for x in columns] for r in want.fetchall()])


def test_every_operator_has_its_query(spark):
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def good(text: str, learned: rules.DecisionList) -> bool:
    words, chars, symbols, dups, repeated = brute_statistics(text)
    n, w = max(words, 1), re.findall(r"[^\x20\x09-\x0D]+", text)
    value = {
        "symbols_per_word": symbols / n, "marks_per_word": sum(map(text.count, "!?")) / n, "upper_share": len(re.findall("[A-Z]", text)) / max(chars, 1), "mean_word_length": chars / n,
        "repeat_share": repeated / n, "distinct_share": len(set(w)) / n, "dup_lines_per_word": dups / n, "n_words": words,
    }
    rejected = any(all((value[c.feature] > c.threshold) == c.above for c in rule) for rule in learned.rules)
    return words >= 50 and 100 * repeated <= 50 * words and not rejected


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [messy.shingles(messy.plain_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, "test")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != names[-1]:
            assert docs.columns == columns
    quality, lines, joined, clean, coded = (out[n] for n in names)
    source = spark.read.parquet(f"{sf}/documents.parquet")
    learned = rules.learn(source, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(quality) == {r.doc_id for r in source.collect() if good(r.text, learned)}
    earlier, want = [], {}
    for i in sorted(quality):
        kept = []
        for line in quality[i].text.split("\n"):
            s = messy.shingles(messy.space_words(line))
            if not any(messy.similar(s, e) for e in earlier):
                kept.append(line)
            earlier.append(s)
        text = "\n".join(kept)
        if text == quality[i].text or messy.space_words(text):
            want[i] = text
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) for r in lines.values())
    sets = {i: messy.shingles(messy.space_words(t)) for i, t in want.items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[j] != root[i] and messy.similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert set(joined) == {i for i in root if root[i] == i}
    leaks = {i for i in joined if any(b and 100 * len(b & messy.shingles(messy.plain_words(want[i]))) >= 80 * len(b) for b in bench)}
    assert leaks and set(clean) == set(joined) - leaks
    codec = pieces.Codec(queries.piece_settings())
    assert {i: codec.decode(np.array(r.ids, "<i4")) for i, r in coded.items()} == {i: r.text for i, r in clean.items()}
    assert corpus_pipeline.ORACLE_SQL is None
