"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

A word is split into characters; an agenda holds every pair of neighbours that is a piece, best score first, then
leftmost. Each candidate that comes up is skipped if its keyed hash falls below ``dropout``; else the pair is merged
and its new pairs are put on the agenda. The hash's key is the seed, doc_id, the word's number in the text and the
candidate's number in the word, so every occurrence of a word is drawn afresh and the same document is always cut
alike. A word's cut depends on the skipped candidates alone, so each (word, skipped candidates) is kept once worked
out, with the number of candidates that came up: an occurrence none of whose draws so far is a further skip has its
cut, else the first further skip is added and looked up. Cuts are looked up by a hash and held against the word's
bytes, which their ids spell. With dropout 0 the result is the library's own.

No piece has anything before a space mark but other space marks, so words (space marks and what follows) are
independent; a model for which this does not hold is refused. Characters outside the vocabulary, and a space mark
that stands in the text itself, become byte pieces, so that decoding gives back every text exactly.

Null texts are encoded as empty texts (no ids) and so decode to empty texts; repeated rows are encoded alike; a null
doc_id counts as 0 in the hash. Extra columns pass through untouched, unless they have an output's name: those are
replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Set
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytehash import IdTable, Remembering, Spelling, U, scramble, span_hashes
from .common import slices, small_batches

MARK = "▁"
M64 = (1 << 64) - 1


def mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


EMPTY = np.zeros(0, np.uint32)
#: The longest words, in characters, that are worked out side by side; the rank of what is no piece.
SIDE_BY_SIDE, NEVER = 24, 1 << 40
#: Of 64 draws, the first k.
FIRST = np.array([(1 << k) - 1 for k in range(65)], U)


def bits_of(x: int) -> list[int]:
    return [k for k in range(x.bit_length()) if x >> k & 1]


def below(x: np.ndarray) -> np.ndarray:
    """All bits up to the highest that is set."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> U(k)
    return x


@dataclass(frozen=True)
class Settings:
    model: str
    dropout: float = 0.1
    seed: int = 17
    bits: int = 20
    """Each of a worker's two tables of words has room for 2 ** bits."""


class Remembered:
    """Two generations: when the new one is full it becomes the old one, so what is used often stays."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key: str, value: tuple[bytes, int]) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Codec:
    def __init__(self, settings: Settings):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(settings.model, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a merge model with byte fallback and without normalization is needed")
        self.prefix = spec.add_dummy_prefix
        self.s = settings
        self.bytes = [b""] * 256
        self.coded: dict[str, bytes] = {}
        """Ids of pieces, as little-endian int32."""
        self.raw: list[bytes] = []
        inside = set()
        for i, p in enumerate(model.pieces):
            code = i.to_bytes(4, "little")
            if p.type == 6:
                byte = int(p.piece[3:5], 16)
                self.bytes[byte] = code
                self.raw.append(bytes([byte]))
            elif p.type == 1:
                self.coded[p.piece] = code
                self.raw.append(p.piece.replace(MARK, " ").encode())
                inside.update(p.piece[k : k + 2] for k in range(len(p.piece) - 1))
            else:
                self.raw.append(b"")
        if any(x[1] == MARK != x[0] for x in inside):
            raise ValueError("a piece has a space mark behind another character")
        longer = [p for p in model.pieces if p.type == 1 and len(p.piece) > 1]
        rank = {x: r for r, x in enumerate(sorted({p.score for p in longer}, reverse=True))}  # equal scores: leftmost first
        self.pieces = {p.piece: rank[p.score] for p in longer}
        self.inside, joined = inside, {c for x in inside for c in x}
        # characters that are in no longer piece stand alone, which makes words return more often
        self.kind = np.zeros(256, np.int8)
        self.kind[ord(" ")] = 1
        self.kind[[ord(c) for c in "\n\t\r" if c not in joined]] = 2
        self.threshold = round(settings.dropout * (1 << 16))
        self.single = np.full(max(map(ord, filter(lambda p: len(p) == 1, self.coded))) + 2, -1, np.int64)
        """The piece of each character; a space is a space mark."""
        ids = {p: int.from_bytes(x, "little") for p, x in self.coded.items()}
        for p, i in ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.single[ord(" ")], self.single[ord(MARK)], self.single[-1] = self.single[ord(MARK)], -1, -1
        splits = [(ids[p[:k]], ids[p[k:]], r, ids[p]) for p, r in self.pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        a, b, r, i = np.array(splits, np.int64).reshape(-1, 4).T
        keys = scramble((a.astype(U) << U(32)) + b.astype(U) + U(1))
        self.pairs = IdTable((4 * len(keys)).bit_length())
        self.pairs.add(keys, np.zeros(0, np.uint32), np.zeros(len(keys), np.int64))
        self.pair_rank, self.pair_id = np.full(self.pairs.mask + 1, NEVER), np.full(self.pairs.mask + 1, -1)
        slots = self.pairs.find(keys)
        self.pair_rank[slots], self.pair_id[slots] = r, i
        self.spelling = Spelling(self.raw)
        self.known = Remembering(settings.bits)
        self.units = Remembered(50_000)

    def draws(self, keys: np.ndarray) -> np.ndarray:
        """64 draws for each key, a bit each: 1, with a probability of threshold / 2 ** 16, for a skip."""
        out = np.zeros(len(keys), U)
        if self.threshold >> 16:
            return ~out
        for b in range(16):  # from the lowest bit of the threshold; a random number is below it where the highest bit that differs is the threshold's
            if self.threshold & ((2 << b) - 1):
                drawn = scramble(keys + U((b + 1) * 0x9E3779B97F4A7C15 & M64))
                out = out | drawn if self.threshold >> b & 1 else out & drawn
        return out

    def segment(self, word: str, skips: Set[int] = frozenset(), j: int = 0) -> tuple[bytes, int]:
        """Ids of one unit or word, as little-endian int32, and the number of candidates that came up, counted on from j. Those
        whose numbers are in skips are skipped."""
        get = self.pieces.get
        parts: list[str | None] = list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is the piece's rank (best score first), then the left part's place
        agenda = [r << 32 | k for k in range(n - 1) if (r := get(word[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            if (a := parts[left]) is None or (right := after[left]) >= n or get(piece := a + parts[right]) != entry >> 32:
                continue  # one of the two has been merged with another meanwhile
            j += 1
            if j - 1 in skips:
                continue
            parts[left], parts[right] = piece, None
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                if (r := get(piece + parts[beyond])) is not None:
                    heapq.heappush(agenda, r << 32 | left)
            if (k := before[left]) >= 0 and (r := get(parts[k] + piece)) is not None:
                heapq.heappush(agenda, r << 32 | k)
        out, coded = [], self.coded
        for p in parts:
            if p is not None:
                if (x := coded.get(p)) is None:
                    x = b"".join([self.bytes[c] for c in p.encode()])
                out.append(x)
        return b"".join(out), j

    def encode(self, texts: list[str], doc_ids: list[int | None]) -> list[np.ndarray]:
        """Ids of each text, as int32."""
        lead = " " if self.prefix else ""
        coded = [(lead + t).encode() if t else b"" for t in texts]
        bounds = np.cumsum([0, *map(len, coded)])
        whole = b"".join(coded)
        data = np.frombuffer(whole, np.uint8)
        kind = self.kind[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = (kind[1:] == 2) | (kind[:-1] == 2) | (kind[1:] == 1) & (kind[:-1] != 1)
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        cuts = np.searchsorted(starts, bounds)
        words = np.diff(cuts)
        seeds = np.array([mix((self.s.seed ^ mix((d or 0) & M64)) & M64) for d in doc_ids], np.uint64)
        number = np.arange(len(starts)) - np.repeat(cuts[:-1], words)
        places = scramble(np.repeat(seeds, words) + number.astype(U))
        drawn = self.draws(places)
        named = span_hashes(data, starts, ends)
        skips = np.zeros(len(starts), U)  # of each word, those of its draws that count so far
        at, found, size = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        kept, total = [], 0
        others = np.zeros(len(starts), bool)  # words for which another's cut was found
        while len(at):

            def make(new: np.ndarray, at: np.ndarray = at) -> list[np.ndarray]:
                spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
                return self._entries([whole[i:j].decode() for i, j in spans], skips[at[new]])

            ids, counts = self.known.ids(scramble(named[at] ^ scramble(skips[at])), make)
            first = np.cumsum(counts) - counts
            found[at], size[at] = total + first + 1, counts - 1
            kept.append(ids)
            total += len(ids)
            came = ids[first].astype(np.int64)
            cut = np.ones(len(ids), bool)
            cut[first] = False
            others[at[self.spelling.wrong(ids[cut], counts - 1, data, starts[at], ends[at])]] = True
            far = np.flatnonzero(came > 64)
            if self.threshold and len(far):  # more candidates than draws: worked out for this place alone
                for k in at[far].tolist():
                    ids = self._far(whole[starts[k] : ends[k]].decode(), places[k])
                    found[k], size[k] = total, len(ids)
                    kept.append(ids)
                    total += len(ids)
            rest = drawn[at] & ~below(skips[at]) & FIRST[np.minimum(came, 64)]
            more = np.flatnonzero((rest != 0) & (came <= 64))
            at, rest = at[more], rest[more]
            skips[at] |= rest & (~rest + U(1))  # the first further skip
        for k in np.flatnonzero(others).tolist():
            ids = self._far(whole[starts[k] : ends[k]].decode(), places[k])
            found[k], size[k] = total, len(ids)
            kept.append(ids)
            total += len(ids)
        upto = np.cumsum(size)
        ids = np.concatenate([*kept, EMPTY])[np.arange(upto[-1] if len(upto) else 0) + np.repeat(found - upto + size, size)].view(np.int32)
        upto = np.concatenate([[0], upto])[cuts].tolist()
        return [ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]

    def _entries(self, words: list[str], skips: np.ndarray) -> list[np.ndarray]:
        """For each word the number of candidates that came up, then the ids. Short words of known characters are
        worked out side by side, a candidate of each at a time."""
        out: list[np.ndarray] = [EMPTY] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) <= SIDE_BY_SIDE and MARK not in w:
                short.append(i)
            else:
                ids, came = self._cut(w, frozenset(bits_of(int(skips[i]))))
                out[i] = np.frombuffer(came.to_bytes(4, "little") + ids, np.uint32)
        for k in range(0, len(short), 4096):
            self._side_by_side(words, skips, short[k : k + 4096], out)
        return out

    def _side_by_side(self, words: list[str], skips: np.ndarray, which: list[int], out: list[np.ndarray]) -> None:
        n = np.array([len(words[i]) for i in which])
        wide, rows = int(n.max()) + 1, np.arange(len(which))
        chars = np.frombuffer("".join([words[i].ljust(wide, "\0") for i in which]).encode("utf-32-le"), np.uint32).reshape(-1, wide)
        inner = np.arange(wide) < n[:, None]
        part = np.where(inner, self.single[np.minimum(chars, len(self.single) - 1)], -1)
        whole = (part >= 0) | ~inner
        rank, joined = np.full(part.shape, NEVER), np.full(part.shape, -1)
        rank[:, :-1], joined[:, :-1] = self.pair(part[:, :-1], part[:, 1:])
        before, after = np.tile(np.arange(-1, wide - 1), (len(which), 1)), np.tile(np.arange(1, wide + 1), (len(which), 1))
        bits, came, live = skips[which], np.zeros(len(which), np.int64), rows
        while len(live):
            left = rank[live].argmin(1)  # of equal ranks the leftmost
            some = rank[live, left] < NEVER
            live, left = live[some], left[some]
            skip = (bits[live] >> np.minimum(came[live], 63).astype(U) & U(1)).astype(bool) & (came[live] < 64)
            came[live] += 1
            rank[live[skip], left[skip]] = NEVER
            row, left = live[~skip], left[~skip]
            right = after[row, left]
            beyond, back = after[row, right], before[row, left]
            part[row, left], part[row, right] = joined[row, left], -1
            rank[row, right] = NEVER
            after[row, left] = beyond
            before[row, np.minimum(beyond, wide - 1)] = left
            rank[row, left], joined[row, left] = self.pair(part[row, left], part[row, np.minimum(beyond, wide - 1)])
            has = back >= 0
            row, left, back = row[has], left[has], back[has]
            rank[row, back], joined[row, back] = self.pair(part[row, back], part[row, left])
        stays = part >= 0
        flat, counts = part[stays].astype(np.uint32), stays.sum(1)
        upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
        flat = np.insert(flat, upto[:-1], came.astype(np.uint32))
        for k, (i, known) in enumerate(zip(which, whole.all(1).tolist(), strict=True)):
            if known:
                out[i] = flat[upto[k] + k : upto[k + 1] + k + 1]
            else:  # a character outside the vocabulary
                ids, c = self._cut(words[i], frozenset(bits_of(int(skips[i]))))
                out[i] = np.frombuffer(c.to_bytes(4, "little") + ids, np.uint32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the piece that two parts make, NEVER for none, and the piece's id."""
        slot = self.pairs.find(scramble((a.astype(U) << U(32)) + b.astype(U) + U(1)).ravel()).reshape(a.shape)
        slot[(a < 0) | (b < 0)] = -1
        return np.where(slot < 0, NEVER, self.pair_rank[slot]), np.where(slot < 0, -1, self.pair_id[slot])

    def _far(self, word: str, place: int) -> np.ndarray:
        """Ids of a word of any length at a place. A word of n characters has fewer than 3 * n candidates; draws behind
        the first 64 have keys of their own."""
        more = np.arange(-(-3 * len(word) // 64), dtype=U)
        drawn = self.draws(np.where(more == 0, U(place), scramble(U(place) ^ scramble(more))))
        skips = np.flatnonzero(np.unpackbits(drawn.view(np.uint8), bitorder="little")).tolist()
        return np.frombuffer(self._cut(word, frozenset(skips))[0], np.uint32)

    def _cut(self, word: str, skips: Set[int], j: int = 0) -> tuple[bytes, int]:
        """Ids and the number of candidates, counted on from j. No merge spans two characters that stand side by side
        in no piece: the word falls into units there, which are kept as they are cut without skips."""
        out, a, inside, units, began = [], 0, self.inside, self.units, j
        if MARK in word:  # the text's own
            for part in word.split(MARK):
                x, j = self._cut(part, skips, j) if part else (b"", j)
                out.append(x)
            return b"".join([self.bytes[x] for x in MARK.encode()]).join(out), j
        word = word.replace(" ", MARK)
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in inside:
                u, a = word[a:k], k
                if (known := units.new.get(u)) is None:
                    known = units.old.get(u) or self.segment(u)
                    if len(u) <= 64:
                        units.put(u, known)
                out.append(known[0])
                j += known[1]
        return (b"".join(out), j) if skips.isdisjoint(range(began, j)) else self.segment(word, skips, began)

    def decode(self, ids: np.ndarray) -> str:
        whole = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (whole[1:] if self.prefix and whole[:1] == b" " else whole).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(settings: Settings) -> Codec:
    """One codec a worker process, kept from task to task."""
    return Codec(settings)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, settings: Settings, output: str = "ids") -> DataFrame:
    """docs' columns and ``ids`` array<int>."""
    small_batches(docs.sparkSession)
    docs = docs.drop(output)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(settings)
        for part in slices(batches, at):
            ids = codec.encode([t or "" for t in part.column("text").to_pylist()], part.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], names=[*part.schema.names, output])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, settings: Settings, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """encoded's columns and the text that the ids spell; null ids give null."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop(output)
    schema = T.StructType([*encoded.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(settings)
        for part in batches:
            texts = [None if x is None else codec.decode(np.asarray(x, "<i4")) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, output])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, settings: Settings) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), text_crc32 (of the
    decoded text) and lossless (it is the text)."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(settings)
        for part in slices(batches, 1):
            rows = []
            doc_ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            for d, t, ids in zip(doc_ids, texts, codec.encode(texts, doc_ids), strict=True):
                back = codec.decode(ids)
                rows.append((d, len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode()), back == t))
            names = ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
