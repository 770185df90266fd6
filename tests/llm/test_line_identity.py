"""Line dedup tells sets by more than a short hash, and does not multiply with repeated rows."""

from __future__ import annotations

import numpy as np

from lodestone.llm import jaccard, linededup, shingling

from . import messy
from .test_messy_documents import brute_lines


def kept(spark, texts, **options):
    rows = linededup.dedup_lines(messy.documents(spark, texts), **options).select("doc_id", "text").collect()
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


def removed(spark, texts, **options):
    docs = messy.documents(spark, texts).select("doc_id", "text")
    return {(r.doc_id, k) for r in linededup.removed_lines(docs, **options)[0].collect() for k in r.lines}


def test_lines_whose_tokens_agree_in_44_bits(spark):
    texts = [(1, "bismo donmo fonri gismo eista"), (2, "jista hinne dedmo einri fislo")]
    assert kept(spark, texts) == sorted((str(i), t) for i, t in texts)


def test_equal_lines_of_documents_whose_texts_nearly_collide(spark):
    shared = "alpha beta gamma delta epsilon zeta eta theta"
    texts = [(None, f"{shared}\nrow 7579"), (None, f"{shared}\nrow 50436")]
    assert sorted(t.count(shared) for _, t in kept(spark, texts)) == [0, 1]


def test_different_sets_of_one_signature(spark):
    """With 3 bits all sets share eight signatures; the result is that of 64 bits."""
    texts = [(k, messy.prose(k % 25, 9) + "\n" + messy.prose(30 + k % 7, 30) + f" w{k}\n" + messy.prose(k, 5)) for k in range(60)]
    whole = removed(spark, texts)
    assert whole and removed(spark, texts, sig_bits=3) == whole
    want = brute_lines(texts)
    assert kept(spark, texts) == sorted((str(i), want[(i, t)]) for i, t in texts)


def test_documents_of_one_signature(spark):
    base = messy.prose(50, 60)
    texts = [(k, " ".join(["start", *base.split()[: 30 + k % 3], f"end{k % 9}"]) if k % 2 else messy.prose(k % 11, 12 + k % 5)) for k in range(80)]
    docs = messy.documents(spark, [*texts, *messy.TEXTS])
    told = lambda **x: sorted(map(str, jaccard.link(docs, **x).collect()))
    assert told(sig_bits=3) == told()


def test_tokens_that_agree_in_their_upper_bits():
    s = np.array([5 << 20 | 3, 5 << 20 | 1, 5 << 20 | 3, 7 << 20, 5 << 20 | 1], np.uint64)
    t, c, line = shingling.distinct(s, s, np.array([0, 0, 0, 0, 1]))
    assert t.tolist() == c.tolist() == [5 << 20 | 1, 5 << 20 | 3, 7 << 20, 5 << 20 | 1] and line.tolist() == [0, 0, 0, 1]
    pack = lambda *x: np.array(x, np.uint64).tobytes()
    na, nb, common = linededup.overlaps([pack(1, 2, 3), pack(4)], [pack(2, 3, 9, 10), pack(5)])
    assert (na.tolist(), nb.tolist(), common.tolist()) == ([3, 1], [4, 1], [2, 0])


def test_repeated_rows_do_not_multiply(spark, monkeypatch):
    """20 near pairs of lines in two documents; however often the rows are repeated, each set is fetched once."""
    a, b = (messy.prose(k, 30) for k in (1, 2))
    lines = [messy.prose(100 + k, 25) for k in range(20)]
    first, second = "\n".join([a, *lines]), "\n".join([b, *[x + " end" for x in lines]])
    seen = []
    fetch = linededup.fetch_lines

    def counted(*args):
        sets, path = fetch(*args)
        seen.append((sets.count(), sets.select("id").distinct().count()))
        return sets, path

    monkeypatch.setattr(linededup, "fetch_lines", counted)
    for times in (1, 30):
        texts = [(1, first), (2, second)] * times
        out = kept(spark, texts)
        assert out.count(("2", b)) == times and out.count(("1", first)) == times
    assert seen[0] == seen[1] == (40, 40)


def test_a_text_of_very_many_lines(spark):
    shared = messy.prose(3, 12)
    text = "\n".join(shared if k % 2 else f"line number {k} of the long text" for k in range(20_000))
    (_, got), = kept(spark, [(1, text)])
    assert got.count(shared) == 1 and got.count("\n") < 20_000
