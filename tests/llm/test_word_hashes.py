"""Words that a polynomial hash modulo 2**64 cannot tell apart, and words that share a hash."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import bytehash, jaccard, linededup, pieces, queries, shingling, tokenfile

from . import messy


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters, the one the other with a and b exchanged."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


WORDS = [w for n in (64, 512, 1024, 2048) for w in thue_morse(n)]


def hashes(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return bytehash.span_hashes(data, *shingling.word_spans(data))


def test_hashes_differ():
    many = [*WORDS, *(w * k for w in ("a", "ab", "abc") for k in range(1, 100)), *messy.prose(1, 5000).split()]
    assert len(set(hashes(many).tolist())) == len(set(many))
    assert np.array_equal(hashes(many), np.concatenate([hashes([w]) for w in many]))


def few_hashes(data, starts, ends):
    """Only two hashes of words."""
    return bytehash.scramble((ends - starts).astype(np.uint64) % np.uint64(2) + np.uint64(1))


@pytest.mark.parametrize("colliding", [False, True])
def test_token_ids_are_the_library_s(colliding, monkeypatch):
    from tokenizers import Tokenizer

    if colliding:
        monkeypatch.setattr(tokenfile, "span_hashes", few_hashes)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = [*WORDS, " ".join(WORDS), messy.BASE, "", "  two  words \n", "é Ünïcode 日本語 <|endoftext|>"]
    library = Tokenizer.from_file(path)
    encoder = tokenfile.ByteLevelEncoder(path)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("colliding", [False, True])
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_pieces_are_lossless(dropout, colliding, monkeypatch):
    texts = [*WORDS, " ".join(WORDS), messy.BASE, "", "  two  words \n", "é ▁Ünïcode 日本語"]
    settings = pieces.Settings(queries.tokenizer_path("piece_bpe_32k.model"), dropout=dropout)
    want = pieces.Codec(settings).encode(texts, list(range(len(texts))))
    if colliding:
        monkeypatch.setattr(pieces, "span_hashes", few_hashes)
    codec = pieces.Codec(settings)
    for _ in range(2):
        got = codec.encode(texts, list(range(len(texts))))
        assert [codec.decode(x) for x in got] == texts and [x.tolist() for x in got] == [x.tolist() for x in want]


@pytest.mark.parametrize("n", [1024, 2048])
def test_documents_and_lines_stay_apart(spark, n):
    a, b = thue_morse(n)
    texts = [(1, a), (2, b), (3, f"one two three four {a}"), (4, f"one two three four {b}")]
    got = {r.doc_id: r.component_id for r in jaccard.link(messy.documents(spark, texts)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    lines = linededup.dedup_lines(messy.documents(spark, texts), short=True).collect()
    assert {(r.doc_id, r.text) for r in lines} == set(texts)
