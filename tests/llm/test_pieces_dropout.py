"""Merge-dropout is drawn afresh for every occurrence of a word."""

from __future__ import annotations

import collections
import re

import numpy as np

from lodestone.llm import pieces, queries

from . import messy


def settings(dropout):
    return pieces.Settings(queries.tokenizer_path("piece_bpe_32k.model"), dropout=dropout)


def by_word(codec, text, ids):
    """The cuts of the words of a text, without regard to which word is where: pieces that begin a word begin a cut."""
    cuts, starts = [], [codec.raw[i].startswith(b" ") for i in ids.tolist()]
    for i, new in zip(ids.tolist(), starts, strict=True):
        if new:
            cuts.append(())
        cuts[-1] += (i,)
    assert len(cuts) == len(text.split(" "))
    return cuts


def test_a_frequent_word_is_cut_in_many_ways():
    codec = pieces.Codec(settings(0.1))
    text = " ".join(["station"] * 20_000)
    cuts = collections.Counter(by_word(codec, text, codec.encode([text], [1])[0]))
    plain, candidates = codec.segment("▁station")
    rng = np.random.default_rng(3)
    free = collections.Counter(codec.segment("▁station", set(np.flatnonzero(rng.random(3 * candidates) < 0.1).tolist()))[0] for _ in range(20_000))
    assert len(cuts) > 5 and free[plain] < 19_000
    for cut, n in free.items():
        assert abs(cuts[tuple(np.frombuffer(cut, np.int32).tolist())] - n) < 400


def test_each_place_has_its_own_draws():
    """Every word worked out alone, from all its draws, by the agenda."""
    text = " ".join([messy.LONG[:20_000].replace("\n", " "), messy.BASE, "x" * 200, "Ünïcode 日本語 " * 20, "the station " * 300, "a" + "internationalization" * 9])
    for dropout in (0.1, 0.5, 1.0):
        codec = pieces.Codec(settings(dropout))
        ids = codec.encode([text], [5])[0]
        seed = np.uint64(pieces.mix((codec.s.seed ^ pieces.mix(5)) & pieces.M64))
        want = []
        for k, word in enumerate(re.findall(r" +[^ ]*", " " + text)):
            place = pieces.scramble(np.array([seed + np.uint64(k)]))[0]
            want += codec._far(word, place).tolist()
        assert ids.tolist() == want
        assert codec.decode(ids) == text
        assert pieces.Codec(settings(dropout)).encode(["other words", text], [4, 5])[1].tolist() == want
