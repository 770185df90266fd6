"""Every operator on documents over messy rows and over no rows, against brute force."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, jaccard, licenses, linededup, pieces, queries, rules, sharding, tokenfile

from . import messy


@pytest.fixture(scope="module")
def docs(spark):
    return messy.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return messy.documents(spark, [])


def pairs(rows):
    return collections.Counter(rows)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c, covered = collections.Counter(g), set()
    for k, x in enumerate(g):
        if c[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, none, spark):
    some = messy.documents(spark, [(k, t) for k, t in enumerate(["a b c", "a b c a b c", "a a a a", "a a a", "a b a b a", "x a b c y a b c", "#*$%&|<> ok", "q\nq\n\nq\nr", "a b c d a b c d a b"])])
    got = docs.unionByName(some).select("text", rules.statistics(F.col("text")).alias("s")).select("text", "s.*").collect()
    for r in got:
        assert tuple(r)[1:6] == brute_statistics(r.text), r.text
    assert none.select(rules.statistics(F.col("text"))).count() == 0


def test_long_statistics_take_the_wide_form(spark, monkeypatch):
    monkeypatch.setattr(rules, "POSITION_BITS", 4)
    text = messy.prose(3, 50) + " " + messy.prose(3, 40)
    got = spark.createDataFrame([(text,)], "text string").select(rules.statistics(F.col("text")).alias("s")).first().s
    assert got.n_repeat_words == brute_statistics(text)[4] == 80


def test_rules(spark, docs, none):
    many = [(k, messy.prose(k, 90) if k % 2 else " ".join(w + "###" for w in messy.prose(k, 90).split())) for k in range(200)]
    known = labels(spark, [(k, k % 2, None) for k in range(200)] + [(3, None, 1), (None, 1, 0), (5, 1, 0)])
    learned = rules.learn(messy.documents(spark, many), known)
    assert len(learned.rules) == 1 and "symbols_per_word >" in str(learned)
    kept = rules.judge(messy.documents(spark, many), known).select("doc_id", F.col("judged.kept").alias("k")).collect()
    assert all(r.k == bool(r.doc_id % 2) for r in kept) and len(kept) == 200
    assert str(rules.learn(docs, labels(spark))) == "\nELSE keep"
    row = {(r.doc_id, r.text): r.judged for r in rules.judge(docs, labels(spark)).collect()}
    assert not row[(17, "word " * 300)].kept and row[(17, "word " * 300)].base_failed and row[(0, messy.BASE)].kept and not row[(4, None)].kept
    assert rules.judge(none, known).count() == 0


def test_jaccard(docs, none):
    sets = {(i, t): messy.shingles(messy.space_words(t)) for i, t in messy.TEXTS}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            if messy.similar(sets[keys[a]], sets[keys[b]]):
                parent[find(keys[a])] = find(keys[b])
    smallest = {}
    for k in keys:
        if k[0] is not None and sets[k]:
            smallest[find(k)] = min(k[0], smallest.get(find(k), k[0]))
    want = pairs((i, len(sets[(i, t)]), smallest.get(find((i, t)), i) if sets[(i, t)] else i) for i, t in messy.TEXTS)
    assert pairs(map(tuple, jaccard.link(docs).collect())) == want
    assert jaccard.link(none).count() == 0
    left = [r.doc_id for r in jaccard.drop_linked(docs).select("doc_id").collect()]
    assert {1, 2, 3, 8, 1 << 62}.isdisjoint(left) and {0, 4, 5, 6, 7, 9, -3} <= set(left) and left.count(16) == 2 and left.count(None) == 2
    assert jaccard.drop_linked(docs).columns == docs.columns


def test_jaccard_with_frequent_shingles_and_chains(spark, monkeypatch):
    shared = messy.prose(77, 40)
    texts = [(k, shared + " " + messy.prose(k, 20 + k % 30)) for k in range(150)]  # a passage that all have
    chain = messy.prose(500, 200).split()
    for k in range(12):  # neighbours link, ends do not
        chain[k * 12] = f"edit{k}"
        texts.append((1000 + k, " ".join(chain)))
    got = {r.doc_id: r.component_id for r in jaccard.link(messy.documents(spark, texts), sketch_bits=16).collect()}
    sets = {i: messy.shingles(messy.space_words(t)) for i, t in texts}
    for i in range(1000, 1012):
        assert got[i] == 1000
    assert not messy.similar(sets[1000], sets[1011])
    assert all(got[i] == min(j for j in range(150) if messy.similar(sets[i], sets[j])) for i in range(150))


def brute_lines(texts):
    """Lines that stay, by (doc_id, text); rows of one doc_id in either order must agree, as no line is in both."""
    earlier, out = [], {}
    for i, t in sorted({x for x in texts if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        kept = []
        for line in t.split("\n"):
            s = messy.shingles(messy.space_words(line))
            if not any(messy.similar(s, e) for e in earlier):
                kept.append(line)
            earlier.append(s)
        out[(i, t)] = "\n".join(kept)
    return out


def test_line_dedup(docs, none):
    got = linededup.dedup_lines(docs, counts="lines")
    assert got.columns == [*docs.columns, "lines"]
    want = brute_lines(messy.TEXTS)
    rows = got.select("doc_id", "text", F.col("lines.n_lines").alias("a"), F.col("lines.n_removed").alias("r")).collect()
    assert pairs((r.doc_id, r.text) for r in rows) == pairs((i, want.get((i, t))) for i, t in messy.TEXTS)
    assert {r.doc_id: (r.a, r.r) for r in rows}[12] == (4, 2) and {r.doc_id: (r.a, r.r) for r in rows}[4] == (0, 0)
    assert linededup.dedup_lines(none).count() == 0


def test_near_lines(spark):
    words = messy.prose(40, 60).split()
    lines = []
    for k in range(30):
        words[k * 2] = f"w{k}"
        lines.append(" ".join(words))
    texts = [(k, f"short line {k}\n{line}\n{messy.prose(k, 9)}") for k, line in enumerate(lines)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(messy.documents(spark, texts)).collect()}
    want = brute_lines(texts)
    assert all(got[i] == want[(i, t)] for i, t in texts) and sum("\n" in t for t in got.values()) == 30


def test_decontamination(spark, docs, none):
    part = " ".join(messy.PASSAGE.split()[5:30])
    items = [(1, part), (2, part.upper()), (3, messy.prose(900, 30)), (4, None), (5, ""), (6, "one two three"), (7, messy.LONG[:3000]), (8, " ".join(part.split()[:22]) + " z y x"), (9, " ".join(part.split()[:15]) + messy.prose(4, 12)), (None, part)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = pairs((r.doc_id, r.item_id, r.n_item, r.n_common) for r in decontam.find_leaks(docs, bench).collect())
    want = []
    for i, t in messy.TEXTS:
        d = messy.shingles(messy.plain_words(t))
        for j, x in items:
            b, n = messy.shingles(messy.plain_words(x)), len(messy.plain_words(x))
            if 0 < n < 5:  # a short item is looked for as it is
                w = messy.plain_words(t)
                d = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            else:
                d = messy.shingles(messy.plain_words(t))
            if b and 100 * len(b & d) >= 80 * len(b):
                want.append((i, j, len(b), len(b & d)))
    assert got == pairs(want) and (11, 1, 21, 21) in got and (12, 8, 21, 18) in got and (10, 7) in {k[:2] for k in got}
    clean = decontam.remove_leaks(docs, bench)
    assert clean.columns == docs.columns
    gone = {k[0] for k in got}
    assert pairs(r.doc_id for r in clean.select("doc_id").collect()) == pairs(i for i, _ in messy.TEXTS if i not in gone)
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_licenses(docs, none):
    got = {(r.doc_id, r.text): r.license for r in licenses.scan(docs).collect()}
    for (i, t), r in got.items():
        w = messy.plain_words(t)
        places = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
        found = {}
        for line in (t or "").split("\n"):
            have = set(messy.plain_words(line))
            for label, text in licenses.TEMPLATES.items():
                want = licenses.template_words(text)
                if len(have & set(want)) >= 0.8 * len(want) - 1e-9:
                    found[label] = max(found.get(label, 0), len(have & set(want)) / len(want))
        every = sorted(x for p in places.values() for x in p)
        base = sorted(k for k, p in places.items() if p)
        assert tuple(r) == (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted({*base, *found})), max(found.values(), default=0.0)), (i, t)
    r = next(v for (i, _), v in got.items() if i == 18)
    assert (r.base_labels, r.labels, r.n_base) == ("cc-by,gpl,mit", "cc-by,cc-by-4.0,cc-by-nc-4.0,cc-by-sa-4.0,gpl,mit", 4)
    assert licenses.scan(none).count() == 0


def test_sharding(spark, docs, none):
    kept, _ = sharding.shuffle_into_shards(docs, shards=7, bucket_bytes=20_000)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.columns[-2:] == ["_slot", "_shard"]
    rows = kept.select("doc_id", "text", "_shard", "_slot").collect()
    assert pairs((r.doc_id, r.text) for r in rows) == pairs(messy.TEXTS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["_shard"]].append(r["_slot"])
    assert len(slots) == 7 and {len(v) for v in slots.values()} <= {3, 4} and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again, _ = sharding.shuffle_into_shards(docs.repartition(5), shards=7, bucket_bytes=20_000)
    same = lambda df: sorted((r["_shard"], r["_slot"], str(r.text)) for r in df.collect())
    assert same(again) == same(kept)
    assert sharding.shuffle_into_shards(none)[0].count() == 0


def test_fisher_yates_is_a_permutation():
    order = sharding.fisher_yates(1000, np.random.default_rng(1))
    assert sorted(order) == list(range(1000)) and list(order) != list(range(1000))
    assert list(sharding.fisher_yates(0, np.random.default_rng(1))) == []


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    written = tokenfile.write_tokens(docs, f"file://{tmp_path}", lambda: tokenfile.byte_level_encoder(path), 50_257, 2, block_ids=100, file_ids=500)
    got = tokenfile.read_tokens(spark, written).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in messy.TEXTS]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert pairs((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == pairs((i, len(x), crc(x)) for i, x in coded)
    assert [r.doc_id for r in got] == sorted((i for i, _ in coded), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
    uri, before, _ = written.files[-1]
    f = tokenfile.TokenFile(uri)
    assert written.bits == 16 and np.array_equal(f.ids(3, f.n_ids), f.ids(0, f.n_ids)[3:]) and len(f.document(0)) == f.starts[1]
    f.close()
    assert tokenfile.write_tokens(none, f"file://{tmp_path}/no", lambda: tokenfile.byte_level_encoder(path), 50_257, 2).files == []


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 29, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and np.array_equal(tokenfile.unpack(data, bits, 1001), ids)
    with pytest.raises(ValueError, match="more than"):
        tokenfile.pack(np.array([2], np.uint32), 1)
    assert tokenfile.bits_for(50_257) == 16 and tokenfile.bits_for(2) == 1


def test_sentencepiece(docs, none):
    import sentencepiece

    model = queries.tokenizer_path("piece_bpe_32k.model")
    settings = pieces.Settings(model, dropout=0.3)
    coded = pieces.encode(docs, settings)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    back = pieces.decode(coded, settings).select("doc_id", "text", "decoded").collect()
    assert len(back) == len(messy.TEXTS) and all(r.decoded == (r.text or "") for r in back)
    assert all(r.lossless for r in pieces.round_trip(docs, settings).collect())
    assert pieces.encode(none, settings).count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [t for _, t in messy.TEXTS if t and "▁" not in t]
    for t, ids in zip(plain, pieces.Codec(pieces.Settings(model, dropout=0)).encode(plain, [0] * len(plain)), strict=True):
        assert ids.tolist() == library.encode(t)
    text = "the station " * 40
    codec = pieces.Codec(settings)
    a, b, c = codec.encode([text] * 3, [1, 1, 2])
    assert a.tolist() == b.tolist() != c.tolist() and len({tuple(x) for x in np.array_split(a, 20)}) > 1
    assert codec.encode([text], [1])[0].tolist() != pieces.Codec(pieces.Settings(model, dropout=0.3, seed=18)).encode([text], [1])[0].tolist()
