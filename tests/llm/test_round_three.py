"""Merkle manifest, SimHash near-dedup and importance resampling against plain Python, over messy rows, no rows and the
given documents."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, queries, resampling, simhash

from . import brute, messy


@pytest.fixture(scope="module")
def docs(spark):
    return messy.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return messy.documents(spark, [])


def given(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


def same(got, want):
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# the manifest


def proofs(spark, docs, **more):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = docs.withColumn("altered", merkle.leaf(*[text if f == "text" else F.col(f) for f in merkle.FIELDS]))
    found = merkle.proofs(spark, merkle.build(docs, carry=("altered",), **more))
    folded = merkle.fold(F.col("proof"), F.col("altered"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("d"), folded.alias("f"), (folded == F.col("root")).alias("v"))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_of_many_sources(spark, height):
    sources = [None, "", " ", "b", "B", "é", "\U0001f600", "a"]
    rows = [(k if k % 11 else None, None if k % 5 == 0 else f"line {k}\nand\n{k}", "en", sources[min(k % 9, 7)] if k < 60 else "hot", k) for k in range(150)]
    rows += rows[70:80]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    same(proofs(spark, df, height=height).collect(), brute.manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))


def test_manifest_of_messy_rows(spark, docs, none):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    same(proofs(spark, docs).collect(), brute.manifest(rows))
    assert proofs(spark, none).collect() == []
    one = docs.where("doc_id = 10")
    got = proofs(spark, one).first()
    assert got.leaf == got.subroot == got.root == brute.manifest([r for r in rows if r[0] == 10])[0][1] and got.d == brute.sha("")


def test_manifest_query(spark, sf):
    got = queries.op11_merkle_manifest(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got.collect(), brute.manifest(given(spark, sf)))


def test_store_has_all_levels(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", None, "s", k) for k in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    store = merkle.build(df, path=f"file://{tmp_path}/store", height=2)
    sizes = {r["level"]: r["count"] for r in store.read(spark, "nodes").groupBy("level").count().collect()}
    assert sizes == {1: 34, 2: 12, 3: 4, 4: 2, 5: 1} and store.read(spark, "leaves").count() == 100


# near duplicates


def test_fingerprints(docs):
    texts = [t for _, t in messy.TEXTS] + ["a b c d " * 40_000]
    assert simhash.fingerprints(texts).tolist() == [brute.fingerprint(t) for t in texts]
    assert simhash.fingerprints(["", None]).tolist() == [0, 0]


def test_simhash_of_messy_rows(docs, none):
    same(simhash.near_duplicates(docs).collect(), brute.simhash(messy.TEXTS))
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_query(spark, sf):
    got = queries.op12_simhash(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    same(got.collect(), brute.simhash([(r[0], r[4]) for r in given(spark, sf)]))


def balls(n, distance, seed):
    """Fingerprints in a few dense balls and at random."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    out = set(rng.integers(0, 1 << 63, n // 4, dtype=np.uint64).tolist())
    while len(out) < n:
        x = int(centres[rng.integers(4)])
        for b in rng.choice(64, rng.integers(0, 2 * distance + 3), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("longest", "mean", "distance"), [(2048, 64, 4), (2048, 1, 4), (3, 64, 4), (3, 1, 4), (40, 1, 2), (5, 1, 1)])
def test_links_at_every_depth_of_the_index(spark, longest, mean, distance):
    fps = balls(400, distance, longest + mean)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, longest, mean).collect()
    assert all((r.a ^ r.b).bit_count() <= distance if (r.a ^ r.b) >= 0 else ((r.a ^ r.b) + (1 << 64)).bit_count() <= distance for r in found)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(r.a)] = find(r.b)
    want = brute.classes(fps, lambda a, b: (a ^ b).bit_count() <= distance)
    pairs = {(find(s), want[x]) for s, x in zip(signed, fps, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("least", range(1, 9))
def test_coverings_miss_no_pair(least):
    import itertools

    for m in range(1, least + 1):
        chosen = [set(c) for c in simhash.covering(m, least)]
        assert all(any(c <= set(x) for c in chosen) for x in itertools.combinations(range(8), least))


# resampling


def test_crcs_of_runs():
    texts = ["", None, "one", "Two  words", "x" * 70 + " y " + "z" * 200 + " tail", "a-b c_d é 日本 " * 5, "w " * 1000]
    n_words, owner, bucket = resampling.features(texts, 3, 10_000)
    assert n_words.tolist() == [len(messy.plain_words(t)) for t in texts]
    for k, t in enumerate(texts):
        assert sorted(bucket[owner == k].tolist()) == sorted(brute.buckets(t).elements())
    data = np.frombuffer(b"abc", np.uint8)
    assert resampling.span_crcs(data, np.array([0]), np.array([3])).tolist() == [zlib.crc32(b"abc")]


@pytest.mark.parametrize("more", [{}, {"block_features": 50, "ranges": 3}])
def test_resampling_of_messy_rows(spark, docs, none, more):
    target = spark.createDataFrame([(1, messy.PASSAGE), (2, None), (3, messy.BASE)], "item_id long, text string")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    for percent in (5, 60):
        got = resampling.resample(docs, target, percent=percent, **more).select(*columns).collect()
        same(got, brute.resample(messy.TEXTS, [messy.PASSAGE, None, messy.BASE], percent))
    got = resampling.resample(docs, target.where("false"), **more).select(*columns).collect()
    same(got, brute.resample(messy.TEXTS, []))
    assert resampling.resample(none, target).collect() == []


def test_resampling_query(spark, sf):
    got = queries.op13_resampling(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(got.collect(), brute.resample([(r[0], r[4]) for r in given(spark, sf)], target))
