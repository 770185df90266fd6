"""Vectorised hashes of pieces of byte strings, and a table from hashes to id lists."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
ODD = 0x9E3779B97F4A7C15
#: Spans of more bytes are hashed one by one by xxh3.
LONG = 64
#: The first k bytes of a little-endian 64-bit number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes of all spans at a time. Spans of the same length up to 8 bytes
    never have the same hash; no structure of longer ones cancels out, as every step is scrambled."""
    n = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    h = scramble(n.astype(U) * U(ODD) ^ eight[starts] & FIRST_BYTES[np.minimum(n, 8)])
    rest, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(rest):
        left = n[rest] - at
        h[rest] = scramble((h[rest] + U(ODD)) ^ eight[starts[rest] + at] & FIRST_BYTES[np.minimum(left, 8)])
        rest, at = rest[left > 8], at + 8
    for k in np.flatnonzero(n > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return h


class Spelling:
    """The bytes that ids stand for, to compare what was found under a hash with what was looked up."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(x) for x in raw], np.int64)
        self.offset = np.cumsum(self.width) - self.width
        flat = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        self.eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))

    def wrong(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the spans data[start:end] that their ids (counts of them each, one after the other) do not
        spell."""
        width, span = self.width[ids], np.repeat(np.arange(len(counts)), counts)
        upto = np.concatenate([[0], np.cumsum(width)])
        firsts = np.cumsum(counts) - counts
        bad = upto[firsts + counts] - upto[firsts] != ends - starts
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        place, source = np.repeat(starts - upto[firsts], counts) + upto[:-1], self.offset[ids]
        np.minimum(place, len(data), out=place)
        bad[span[(eight[place] ^ self.eight[source]) & FIRST_BYTES[np.minimum(width, 8)] != 0]] = True
        rest, at = np.flatnonzero(width > 8), 8
        while len(rest):
            left = width[rest] - at
            differs = (eight[np.minimum(place[rest] + at, len(data))] ^ self.eight[source[rest] + at]) & FIRST_BYTES[np.minimum(left, 8)] != 0
            bad[span[rest[differs]]] = True
            rest, at = rest[left > 8], at + 8
        return np.flatnonzero(bad)


class IdTable:
    """Open addressing from 64-bit hashes to lists of ids, all in arrays."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U)
        self.start = np.zeros(1 << bits, np.int64)
        self.length = np.zeros(1 << bits, np.int32)
        self.store = np.zeros(1 << bits, np.uint32)
        self.used = self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for none."""
        slot = (h & U(self.mask)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, slot, -1)
        rest = np.flatnonzero((found != h) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == h[rest]
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (found != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New distinct hashes and their ids one after the other."""
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.n += len(h)
        slot = (h & U(self.mask)).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            free = self.keys[slot[rest]] == 0
            take = rest[free]
            self.keys[slot[take]] = h[take]  # of several for one slot the last stays
            won = take[self.keys[slot[take]] == h[take]]
            self.start[slot[won]], self.length[slot[won]] = starts[won], lengths[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            rest = rest[lost[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slots, and how many each has."""
        n = self.length[slots].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slots] - (ends - n), n)
        return self.store[at], n


class Remembering:
    """Two generations of tables: what is used stays, the rest goes when the newer table is full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.new, self.old = IdTable(bits), IdTable(4)

    def ids(self, h: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all hashes in order, and the count of each. make(places of first occurrences) gives the id lists of
        hashes that are not known."""
        h = np.where(h == 0, U(1), h)
        if self.new.n + len(h) > 0.7 * (self.new.mask + 1):
            self.old, self.new = self.new, IdTable(max(self.bits, (2 * len(h)).bit_length()))
        slots = self.new.find(h)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            keys, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            known = self.old.find(keys)
            has = known >= 0
            if has.any():
                ids, n = self.old.gather(known[has])
                self.new.add(keys[has], ids, n)
            if not has.all():
                made = make(first[~has])
                self.new.add(keys[~has], np.concatenate(made), np.array([len(x) for x in made], np.int64))
            slots[missing] = self.new.find(h[missing])
        return self.new.gather(slots)
