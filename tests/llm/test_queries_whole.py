"""Registered queries without SQL, over the driver's smallest tables, against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodestone.llm import common, pieces, queries, rules, tokenfile

from .test_messy_documents import brute_statistics
from .test_pipeline import good


def rows_of(spark, sf, name):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()}


def scramble(x: int) -> int:
    return int(pieces.scramble(np.array([x & pieces.M64], np.uint64))[0])


def naive_cut(codec, word: str, place: int) -> list[int]:
    """Merges one pair at a time, looking at all neighbours each time. Draw k of 64 is the 16-bit number of the k-th bits of
    sixteen hashes; a candidate is skipped if its draw is below the threshold."""
    drawn = {}

    def skipped(j: int) -> bool:
        block, k = divmod(j, 64)
        if block not in drawn:
            key = place if block == 0 else scramble(place ^ scramble(block))
            drawn[block] = [scramble(key + (b + 1) * 0x9E3779B97F4A7C15) for b in range(16)]
        return sum((1 - (x >> k & 1)) << b for b, x in enumerate(drawn[block])) < codec.threshold

    parts = [(k, c) for k, c in enumerate(word.replace(" ", pieces.MARK))]
    passed, j = set(), 0
    while True:
        able = [(codec.pieces[a[1] + b[1]], n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[1] + b[1] in codec.pieces and (a, b) not in passed]
        if not able:
            break
        _, n = min(able)
        if skipped(j):
            passed.add((parts[n], parts[n + 1]))
        else:
            parts[n : n + 2] = [(parts[n][0], parts[n][1] + parts[n + 1][1])]
        j += 1
    ids = b"".join(codec.coded.get(p) or b"".join(codec.bytes[x] for x in p.encode()) for _, p in parts)
    return np.frombuffer(ids, np.int32).tolist()


def words_of(codec, text: str) -> list[str]:
    """Spaces and what follows them; white space that is in no piece with anything else stands alone."""
    alone = {c for c in "\n\t\r" if codec.kind[ord(c)] == 2}
    out = []
    for k, c in enumerate(text):
        before = text[k - 1] if k else ""
        if not k or c in alone or before in alone or c == " " != before:
            out.append("")
        out[-1] += c
    return out


def test_op2_against_a_naive_merge_loop(spark, sf):
    codec = pieces.Codec(queries.piece_settings())
    texts = rows_of(spark, sf, "documents")
    got = queries.op2_sentencepiece(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text, ids = texts[r.doc_id], []
        seed = pieces.mix(codec.s.seed ^ pieces.mix(r.doc_id))
        if len(text) < 4000:
            for k, word in enumerate(words_of(codec, " " + text) if text else []):
                if pieces.MARK in word:
                    break
                ids += naive_cut(codec, word, scramble(seed + k))
            else:
                assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes())), r.doc_id
        assert r.lossless and r.text_crc32 == zlib.crc32(text.encode())


def test_op5_against_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    texts, start, want = rows_of(spark, sf, "documents"), 0, []
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op5_token_files(spark, sf).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def naive_cover(x, bad, names, seed=7):
    """Sequential covering, one threshold and one document at a time."""
    rng, left, found = np.random.default_rng(seed), set(range(len(bad))), []
    grids = []
    for j in range(len(names)):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))
        grids.append([(a + b) / 2 for a, b in zip(q, q[1:], strict=False)])
    holds = lambda c, k: bool((x[k, names.index(c.feature)] > c.threshold) == c.above)
    count = lambda group: (sum(bool(bad[k]) for k in group), sum(not bad[k] for k in group))
    while sum(bool(bad[k]) for k in left) >= 3:
        first = rng.random(len(bad)) < 2 / 3
        grow, prune = {k for k in left if first[k]}, {k for k in left if not first[k]}
        rule, here = [], grow
        while len(rule) < 4 and count(here)[1]:
            p0, n0 = count(here)
            best = (1e-9, None)
            for j, name in enumerate(names):
                for above in (False, True):
                    top = (-1.0, None)
                    for cut in grids[j]:
                        c = rules.Condition(name, above, float(cut))
                        p, n = count([k for k in here if holds(c, k)])
                        gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(max(p0, 1e-9) / (p0 + n0))) if p else -1
                        if top[1] is None or gain > top[0]:
                            top = (gain, c)
                    if top[1] is not None and top[0] > best[0]:
                        best = top
            if best[1] is None:
                break
            rule.append(best[1])
            here = {k for k in here if holds(best[1], k)}

        def worth(length):
            p, n = count([k for k in prune if all(holds(c, k) for c in rule[:length])])  # noqa: B023
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        length = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        covered = {k for k in left if all(holds(c, k) for c in rule[:length])}
        p, n = count(covered)
        if p < 3 or p < 0.9 * (p + n) or prune and worth(length) < 0.8:
            break
        found.append(rule[:length])
        left -= covered
    return found


@pytest.mark.parametrize("seed", range(6))
def test_covering_against_a_naive_one(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((90, 3)), 2)
    bad = (x[:, 0] > 0.8) | (x[:, 1] < 0.3) & (x[:, 2] > 0.5) | (rng.random(90) < 0.02 * seed)
    names = ["a", "b", "c"]
    assert rules.cover(x, bad, names, seed).rules == naive_cover(x, bad, names, seed)


def test_op3_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = rules.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = rows_of(spark, sf, "documents")
    got = queries.op3_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, chars, symbols, dups, repeated = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == good(texts[r.doc_id], learned)


def test_windows_that_agree_in_part_of_their_hash(spark, monkeypatch):
    """With 62 bits for positions, windows differ in two bits of the sorted hash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "POSITION_BITS", 62)
    texts = ["a b c d e a b c f g h i j a b c", " ".join("abcdefghij"[k * k % 10] for k in range(300)), "x y z " * 9, " ".join(map(str, range(200)))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rules.statistics(F.col("text")).alias("s")).collect()
    assert all(r.s.n_repeat_words == brute_statistics(r.text)[4] for r in rows)


def test_one_labelled_document_of_very_many_rows(spark):
    from pyspark.sql import functions as F

    many = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text of row "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 0, None)] * 50, "doc_id long, quality int, toxic int")
    assert rules.learn(many, labels).rules == []


def test_a_cluster_needs_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_names_of_file_systems():
    for name in ("file:///tmp", "/tmp"):
        assert tokenfile.file_system(name)[1] == "/tmp"
    assert tokenfile.arrow_uri("s3a://folder/x") == "s3://folder/x" and tokenfile.arrow_uri("hdfs://host:1/x") == "hdfs://host:1/x"
