"""Shingle sets of lines or of whole texts, a slice of texts at a time, in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .bytehash import ODD, U, scramble, span_hashes
from .common import slices

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Two hashes of words in a row have nothing in common but the words' own hashes.
PLACE_VALUE, CHECK_VALUE = np.random.default_rng(21).integers(1, 1 << 63, (2, 64), dtype=np.uint64) * U(2) + U(1)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words between the white space U+0009 to U+000D and space."""
    space = np.ones(len(data) + 2, bool)
    np.less(data - np.uint8(9), 5, out=space[1:-1])
    space[1:-1] |= data == 32
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def combine(w: np.ndarray, n: int, values: np.ndarray = PLACE_VALUE) -> np.ndarray:
    """A hash of each n words in a row."""
    k = len(w) - n + 1
    s = np.full(k, n, U)
    for i in range(n):
        s += w[i : k + i] * values[i]
    return scramble(s)


#: A set's number in a slice and this many bits of a token make one integer to sort by.
SORTED_BITS = 44


class Sets(NamedTuple):
    """The sets of a slice of texts that have any shingle."""

    text: np.ndarray
    line: np.ndarray
    """Number of the text in the slice, and of the line in the text (0 for whole texts)."""
    first: np.ndarray
    counts: np.ndarray
    """Where the set's shingles begin and how many distinct ones it has."""
    tokens: np.ndarray
    """Shingles, sorted within each set."""
    sig: np.ndarray
    check: np.ndarray
    """128 bits that tell the set: of two independent hashes of each shingle."""


NOTHING = Sets(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(2)))


class Shingling(NamedTuple):
    """What a set is: the ``width``-word shingles of each line, or of each text. With ``short`` fewer words are one
    shingle, else none. With fewer ``sig_bits`` more sets agree in their signatures, which changes nothing in a result
    (a test's handle)."""

    width: int = 5
    short: bool = True
    by_line: bool = False
    sig_bits: int = 64

    def sets(self, texts: list[str | None]) -> Sets:
        width = self.width
        coded = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
        data = np.frombuffer(b"\n".join(coded), np.uint8)
        starts, ends = word_spans(data)
        if len(starts) < (1 if self.short else width):
            return NOTHING
        w = span_hashes(data, starts, ends)
        breaks = np.flatnonzero(data == 10) if self.by_line else np.cumsum([len(x) + 1 for x in coded])[:-1] - 1
        unit = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1))[:-1]
        s, c, at = w[:0], w[:0], unit[:0]
        if len(w) >= width:
            whole = np.flatnonzero(unit[width - 1 :] == unit[: len(unit) - width + 1])
            s, c, at = combine(w, width)[whole], combine(w, width, CHECK_VALUE)[whole], unit[whole]
        if self.short:
            begins = np.flatnonzero(np.diff(unit, prepend=-1))
            n_words = np.diff(np.append(begins, len(unit)))
            few = [(combine_at(w, n, k, PLACE_VALUE), combine_at(w, n, k, CHECK_VALUE), unit[k]) for n in range(1, width) if len(k := begins[n_words == n])]
            s, c, at = (np.concatenate(x) for x in zip((s, c, at), *few, strict=True))
        if not len(s):
            return NOTHING
        s, c, unit = distinct(s, c, at)
        first = np.flatnonzero(np.diff(unit, prepend=-1))
        counts = np.diff(np.append(first, len(s)))
        at = unit[first]
        size = counts.astype(U) * U(ODD)
        sig, check = (scramble(np.add.reduceat(scramble(x ^ U(ODD)), first) + size).view(np.int64) for x in (s, c))
        sig = sig >> (64 - self.sig_bits)
        if not self.by_line:
            return Sets(at, np.zeros(len(at), np.int64), first, counts, s, sig, check)
        bounds = np.cumsum([0, *[x.count(b"\n") + 1 for x in coded]])  # first line of each text
        text = np.searchsorted(bounds, at, side="right") - 1
        return Sets(text, at - bounds[text], first, counts, s, sig, check)


def distinct(s: np.ndarray, c: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By unit, then token, each once; c goes with s."""
    if int(unit.max()) < 1 << (64 - SORTED_BITS):
        # the unit and the upper part of the token in one integer, which sorts several times faster than two keys
        key = unit.astype(U) << U(SORTED_BITS) | s >> U(64 - SORTED_BITS)
        order = np.argsort(key)
        t, key = s[order], key[order]
        same = key[1:] == key[:-1]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        new[1:] |= ~same
        if not (same & new[1:]).any():
            order = order[new]
            return t[new], c[order], unit[order]
    order = np.lexsort((s, unit))  # two tokens of a unit agree in the upper part
    t, at = s[order], unit[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (at[1:] != at[:-1])])
    return t[new], c[order][new], at[new]


def combine_at(w: np.ndarray, n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """combine(w, n) at some places."""
    words = w[places[:, None] + np.arange(n)].reshape(-1)
    return combine(words, n, values)[::n]


def first_shingles(classes: np.ndarray, kind: Shingling, percent: int) -> Callable:
    """For jaccard.shared_shingles: of each set in the texts (column 0), the first shingles in the common order, by class,
    then hash; any set that links has one of them."""
    shift = 64 - (len(classes) - 1).bit_length()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        known: set[tuple[int, int]] = set()  # copies within a task; all others meet in their buckets
        for part in slices(batches):
            x = kind.sets(part.column(0).to_pylist())
            if not len(x.first):
                continue
            _, once, mine = np.unique(x.sig, return_index=True, return_inverse=True)
            take = np.zeros(len(x.sig), bool)
            take[once] = True
            take |= x.check != x.check[once][mine]  # another set of the same signature
            if not kind.by_line:
                names = list(zip(x.sig.tolist(), x.check.tolist(), strict=True))
                take &= ~np.fromiter(map(known.__contains__, names), bool, len(names))
                if len(known) < 1_000_000:
                    known.update(names)
            s, c = x.tokens, classes[(x.tokens >> U(shift)).astype(np.int64)]
            at = np.repeat(np.arange(len(x.first)), x.counts)
            if c.any():
                frequent = np.zeros(len(x.first), bool)
                frequent[at[c > 0]] = True
                some = np.flatnonzero(frequent[at])
                order = some[np.argsort(at[some] << 8 | c[some], kind="stable")]  # by hash within a class already
                s[some], c[some] = s[order], c[order]
            place = np.arange(len(s)) - np.repeat(x.first, x.counts)
            p = np.minimum(x.counts, x.counts + (percent * x.counts // -100) + 1)
            keep = np.flatnonzero((place < np.repeat(p, x.counts)) & np.repeat(take, x.counts))
            at = at[keep]
            yield s[keep], x.sig[at], place[keep].astype(np.int32), x.counts[at].astype(np.int32), c[keep]

    return firsts


def only_first(x: Sets, which: np.ndarray) -> np.ndarray:
    """Of the chosen sets of a slice, one of each."""
    order = which[np.lexsort((x.check[which], x.sig[which]))]
    g, c = x.sig[order], x.check[order]
    return np.sort(order[np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])]) if len(order) else order


def token_lists(x: Sets, which: np.ndarray) -> pa.Array:
    """The shingles of the chosen sets (in order), as binary."""
    mine = np.zeros(len(x.first), bool)
    mine[which] = True
    offsets = np.concatenate([[0], 8 * np.cumsum(x.counts[which])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(x.tokens[np.repeat(mine, x.counts)])])
